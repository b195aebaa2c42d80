"""Typed index of texts: occurrences of values, grouped with their documents and anchors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import days_in, name_period, period_text, step_between
from tessera.functions.text import CAPITALISED, IDENTIFIER, ISO_DAY, MONEY, line_anchor, money_value
from tessera.functions.words import mid_sentence


def occurrences(of_lines: DataFrame, pattern: str) -> DataFrame:
    """doc, line, n (from 1 in its line), surface of every match."""
    return of_lines.select("doc", "line", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("n", "surface")).select("doc", "line", (F.col("n") + 1).alias("n"), "surface")


def grouped(found: DataFrame, value: str = "surface") -> DataFrame:
    """value, n, n_docs, surface and anchor of the first occurrence.

    What a value gathers is numbers and one occurrence; its places are rows of `places`.
    """
    first = F.min_by(F.struct("surface", line_anchor(F.col("doc"), F.col("line")).alias("anchor")), F.struct("doc", "line", "n"))
    return found.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), F.count_distinct("doc").alias("n_docs"), first.alias("x")).select("value", "n", "n_docs", "x.surface", "x.anchor")


def places(found: DataFrame, value: str = "surface") -> DataFrame:
    """Where values stand, a row a line: value, doc, anchor."""
    return found.select(F.col(value).alias("value"), "doc", line_anchor(F.col("doc"), F.col("line")).alias("anchor")).distinct()


def placed(found: DataFrame, value: str = "surface") -> DataFrame:
    """The values of `grouped` with all their places, a row each: and doc, place."""
    return grouped(found, value).join(places(found, value).withColumnRenamed("anchor", "place"), "value")


def identifiers(of_lines: DataFrame, by: Callable = grouped) -> DataFrame:
    """Joined tokens that begin with a letter and hold a digit."""
    return by(occurrences(of_lines, IDENTIFIER).where(F.col("surface").rlike("[0-9]")))


def names(of_lines: DataFrame, least_docs: int = 2, by: Callable = grouped) -> DataFrame:
    """Capitalised phrases of two to four words that several documents have."""
    return by(occurrences(of_lines, CAPITALISED)).where(F.col("n_docs") >= least_docs)


def ordinary_words(of_lines: DataFrame) -> DataFrame:
    """Words in capitals that as many lines or more write in lower case: word, n_upper, n_lower."""
    tokens = of_lines.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0))).alias("w"))
    upper, lower = F.col("w").rlike("^[A-Z]{2,}$"), F.col("w").rlike("^[a-z]+$")
    counts = tokens.where(upper | lower).groupBy(F.lower("w").alias("word")).agg(F.count_if(upper).alias("n_upper"), F.count_if(lower).alias("n_lower"))
    return counts.where("n_upper > 0 and n_lower >= n_upper")


def dates(of_lines: DataFrame, by: Callable = grouped) -> DataFrame:
    """ISO days that exist, as dates."""
    return by(occurrences(of_lines, ISO_DAY).withColumn("day", F.try_to_date("surface")).where("day is not null").withColumn("key", F.date_format("day", "yyyy-MM-dd")), "key")


def amounts(of_lines: DataFrame, by: Callable = grouped) -> DataFrame:
    """Dollar amounts by value."""
    return by(occurrences(of_lines, MONEY).withColumn("key", money_value(F.col("surface"))), "key")


def status_claims(of_lines: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """The first line of each document that claims a status: doc, status, line, surface.  Capitalised words only."""
    found = [occurrences(of_lines, rf"\b({'|'.join(words)})\b").withColumn("status", F.lit(kind)) for kind, words in kinds.items()]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc", "status").agg(F.min(F.struct("line", "n", "surface")).alias("first")).select("doc", "status", "first.line", "first.surface")


def version_pairs(claims: DataFrame) -> DataFrame:
    """(identifier, draft, final) from claims (identifier, doc, status, day): a draft before a
    final that share an identifier with exactly one such pair; documents in two pairs drop out.
    """
    draft = claims.where("status = 'draft'").select("identifier", F.col("doc").alias("draft"), F.col("day").alias("draft_day"))
    final = claims.where("status = 'final'").select("identifier", F.col("doc").alias("final"), F.col("day").alias("final_day"))
    pairs = draft.join(final, "identifier").where("draft_day < final_day and draft <> final")
    alone = pairs.withColumn("m", F.count("*").over(Window.partitionBy("identifier"))).where("m = 1").drop("m")
    alone = alone.groupBy("draft", "final", "draft_day", "final_day").agg(F.min("identifier").alias("identifier"))
    twice = alone.select(F.explode(F.array("draft", "final")).alias("doc")).groupBy("doc").agg(F.count("*").alias("m")).where("m > 1")
    return alone.join(twice, alone["draft"] == twice["doc"], "left_anti").join(twice, F.col("final") == twice["doc"], "left_anti")


def constant_steps(series: DataFrame, least: int = 3) -> DataFrame:
    """Series (series, period) whose periods go up by one constant step: series, step, n."""
    ahead = F.col("period") - F.lag("period").over(Window.partitionBy("series").orderBy("period"))
    steps = series.withColumn("step", ahead).groupBy("series").agg(F.count("*").alias("n"), F.min("step").alias("step"), F.max("step").alias("most"))
    return steps.where(f"n >= {least} and step = most and step > 0").select("series", "step", "n")


def document_series(paths: DataFrame, least: int = 2) -> DataFrame:
    """Families of paths (doc) that differ in one period and go up by one constant step: before, after, stem, step, n, first, last."""
    own = paths.select(name_period(F.col("doc")).alias("x")).where("x is not null").select("x.before", "x.after", "x.stem", "x.period")
    w = Window.partitionBy("before", "after").orderBy("period")
    stepped = own.withColumn("prior", F.lag("period").over(w)).withColumn("step", F.when(F.col("prior").isNotNull(), F.coalesce(step_between(F.col("prior"), F.col("period")), F.lit("none"))))
    found = stepped.groupBy("before", "after").agg(F.min("stem").alias("stem"), F.count("*").alias("n"), F.min("step").alias("step"), F.max("step").alias("most"), F.min("period").alias("p"), F.max("period").alias("q"))
    return found.where((F.col("n") >= least) & (F.col("step") == F.col("most")) & (F.col("step") != "none")).select("before", "after", "stem", "step", "n", period_text(F.col("p")).alias("first"), period_text(F.col("q")).alias("last"))


def one_word_names(of_lines: DataFrame, least_docs: int = 2) -> DataFrame:
    """Capitalised words of three letters or more that stand within a sentence in several documents: value, n, n_docs, surface, anchor."""
    every = of_lines.select("doc", "line", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][A-Za-z]{2,}\b"), 0)).alias("n", "surface"))
    # The place of the n-th word is the length of what the first n words and their gaps take.
    gaps = F.split("text", r"\b[A-Z][A-Za-z]{2,}\b")
    before = F.array_join(F.slice(gaps, F.lit(1), F.col("n") + 1), "X")
    inside = every.withColumn("mid", mid_sentence(before))
    names_ = inside.where("mid").groupBy("surface").agg(F.countDistinct("doc").alias("m")).where(F.col("m") >= least_docs).select("surface")
    return grouped(every.select("doc", "line", (F.col("n") + 1).alias("n"), "surface").join(names_, "surface", "left_semi"))


def first_dates(front: DataFrame) -> DataFrame:
    """The first day of each document's front matter (doc, line, text): doc, day."""
    return front.withColumn("day", F.get(days_in(F.col("text")), F.lit(0))).where("day is not null").groupBy("doc").agg(F.min_by("day", "line").alias("day"))
