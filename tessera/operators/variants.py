"""Variants of a room: spellings dealt to documents, and planted values that a clone may not carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import iso_of
from tessera.functions.rewriting import GUARDED, respelled
from tessera.functions.text import collapsed


def carriers(sections: DataFrame, names: DataFrame) -> DataFrame:
    """Documents that write a name outside guarded runs: name, doc.  sections: doc, text.  names: name, spellings.

    A name's words meet the words of texts, so that texts are looked into only for names they may hold.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), 0))
    plain = sections.select("doc", F.regexp_replace("text", GUARDED, "\ue000").alias("text"))
    longest = F.array_max(F.transform(words(F.col("name")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = names.select("name", longest.alias("word"))
    held = plain.select("doc", "text", F.explode(words(F.col("text"))).alias("word")).join(F.broadcast(keyed) if keyed.limit(10_001).count() <= 10_000 else keyed, "word")
    whole = F.concat(F.lit("(?<![A-Za-z])\\Q"), "name", F.lit("\\E(?![A-Za-z])"))
    return held.where(F.regexp("text", whole)).select("name", "doc").distinct()


def dealt(sections: DataFrame, names: DataFrame, seed: int = 0) -> DataFrame:
    """The spelling of every name in every document that writes it: doc, name, spelling.

    A name's documents stand in a seeded order and its spellings are dealt round it, so that a
    name in three documents or more has three spellings at least, where it has that many.
    """
    order = Window.partitionBy("name").orderBy(F.xxhash64(F.lit(seed), "name", "doc"), "doc")
    placed = carriers(sections, names).withColumn("k", F.row_number().over(order) - 1).join(names, "name")
    return placed.select("doc", "name", F.element_at("spellings", (F.col("k") % F.size("spellings") + 1).cast("int")).alias("spelling"))


def rewrite_names(sections: DataFrame, drawn: DataFrame) -> DataFrame:
    """Sections (doc, anchor, text) with the names as their document spells them: doc, anchor, text."""
    own = drawn.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("name", "spelling"))).alias("spelling"))
    joined = sections.join(own, "doc", "left")
    return joined.select("doc", "anchor", F.when(F.col("spelling").isNull(), F.col("text")).otherwise(respelled(F.col("text"), F.coalesce("spelling", F.array().cast("array<struct<name: string, spelling: string>>")))).alias("text"))


def _spaced(value: Column) -> Column:
    """A value as a pattern whose white space is any, and whose `&` may have spaces around it."""
    return F.concat(F.lit("\\Q"), F.regexp_replace(F.regexp_replace(F.trim(value), r"\s*&\s*", r"\\E\\s*&\\s*\\Q"), r"(?<![\\E])\s+(?![*\\])", r"\\E\\s+\\Q"), F.lit("\\E"))


def planted(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """The first planted value that each text carries: id, fact, value.  texts: id, text.  facts: fact, at, kind, value.

    Facts are a key's own, a list of bounded length that goes to every task.  Quotes, comparisons
    and documents count whatever their white space and case; identifiers, numbers and days only
    where they stand alone; days also as another surface writes them.
    """
    flat = lambda c: F.lower(collapsed(c))
    kind = F.col("kind")
    whole = kind.isin("quote", "comparison", "document") & F.contains(flat(F.col("text")), flat(F.col("value"))) & (flat(F.col("value")) != "")
    spaced = _spaced(F.col("value"))
    identifier = (kind == "identifier") & F.regexp("text", F.concat(F.lit("(?i)(?<![A-Za-z0-9&-])"), spaced, F.lit("(?![A-Za-z0-9-])")))
    number = (kind == "number") & F.regexp("text", F.concat(F.lit(r"(?i)(?<![\w.,$-])"), spaced, F.lit(r"(?![\w.,-])")))
    iso = F.regexp_extract_all("text", F.lit(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"), 0)
    surfaces = F.concat(iso, F.transform(F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,2}\s+[A-Za-z]{3,9}\.?\s+[0-9]{4}\b"), 0), iso_of))
    day = (kind == "date") & (F.regexp("text", F.concat(F.lit(r"(?<![\w-])\Q"), "value", F.lit(r"\E(?![\w-])"))) | F.array_contains(surfaces, F.col("value")))
    met = texts.join(F.broadcast(facts.limit(100_000)), whole | identifier | number | day)
    return met.groupBy("id").agg(F.min(F.struct("at", "fact", "value")).alias("x")).select("id", "x.fact", "x.value")
