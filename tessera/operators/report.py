"""Reports and dossiers as lines: headings in force, body lines, rows of evidence, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rows as R
from tessera.functions.dates import days_in
from tessera.functions.text import money_value

# Sections that code writes, and marks of lines without sentences.
WRITTEN_BY_CODE = ("Evidence", "Left out")
NO_SENTENCE = ("Recommendation:", "Calculation:")
# What a document's rows weigh.
COMPARISON_WEIGHT, MODEL_WEIGHT, NAME_WEIGHT = 3, 3, 1


def sections_of(reports: DataFrame) -> DataFrame:
    """Lines below `## ` headings of reports (doc, line, text): doc, line, section, text."""
    heading = F.when(F.col("text").startswith("## "), F.trim(F.substring("text", F.lit(4), F.length("text"))))
    own = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return reports.withColumn("section", F.last(heading, ignorenulls=True).over(own)).where(F.col("section").isNotNull() & ~F.col("text").startswith("## ")).select("doc", "line", "section", "text")


def narrative(reports: DataFrame) -> DataFrame:
    """The lines of sections that were written, not made by code."""
    return sections_of(reports).where(~F.col("section").isin(*WRITTEN_BY_CODE))


def body_lines(reports: DataFrame) -> DataFrame:
    """Lines that carry sentences, trimmed, without list marks: neither blank nor headings, recommendations or calculations."""
    own = reports.withColumn("text", F.trim("text")).where(~F.col("text").startswith("#")).withColumn("text", F.trim(F.regexp_replace("text", R.LIST_MARK, "")))
    return own.where(F.col("text") != "").where(~F.col("text").startswith(NO_SENTENCE[0]) & ~F.col("text").startswith(NO_SENTENCE[1]))


def cited_lines(reports: DataFrame) -> DataFrame:
    """Body lines of narrative sections with the citations they write: doc, line, section, text, cites."""
    return body_lines(narrative(reports)).withColumn("cites", R.citations(F.col("text")))


def without_sections(reports: DataFrame) -> DataFrame:
    """Reports (doc, line, text) that have no written section: doc."""
    return reports.select("doc").distinct().join(narrative(reports).select("doc"), "doc", "left_anti")


def evidence_rows(reports: DataFrame) -> DataFrame:
    """Bullets of the Evidence section: doc, line, document, date, quote, citation; one of another shape is all quote."""
    own = sections_of(reports).where("section = 'Evidence'")
    under = F.last(F.when(F.col("text").startswith("### "), F.trim(F.substring("text", F.lit(5), F.length("text")))), ignorenulls=True)
    own = own.withColumn("document", F.coalesce(under.over(Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)), F.lit(""))).where(F.col("text").startswith("- "))
    shape = r'^- (.*?) \| "(.*)" \| (\[[^\]]*\])$'
    part = lambda k: F.regexp_extract("text", shape, k)
    fits = F.col("text").rlike(shape)
    return own.select("doc", "line", "document", F.when(fits, part(1)).otherwise("").alias("date"), F.when(fits, part(2)).otherwise(F.substring("text", F.lit(3), F.length("text"))).alias("quote"), F.when(fits, part(3)).otherwise("").alias("citation"))


def document_weights(dossier: DataFrame) -> DataFrame:
    """What each document weighs in a dossier's rows (doc, line, section, text): doc, document, weight."""
    weights = F.when(F.col("section") == "Comparisons", COMPARISON_WEIGHT).when(F.col("section") == "Models blind to it", MODEL_WEIGHT).when(F.col("section") == "Names", NAME_WEIGHT)
    named = F.when(F.col("section") == "Comparisons", R.comparison_documents(F.col("text"))).otherwise(F.array(R.row_document(F.col("text"))))
    own = dossier.where(F.col("text").startswith("- ")).select("doc", weights.alias("weight"), F.explode(named).alias("document"))
    return own.where("weight is not null and document <> ''").groupBy("doc", "document").agg(F.sum("weight").alias("weight"))


def first_of_name(rows: DataFrame) -> DataFrame:
    """For each name the first row (doc, line, text) that can be quoted, or the first, in order."""
    ranked = rows.withColumn("name", F.get(R.row_fields(F.col("text")), F.lit(0))).withColumn("r", F.row_number().over(Window.partitionBy("doc", "name").orderBy(~R.is_quotable(F.col("text")), "line")))
    return ranked.where("r = 1").drop("r")


def statements(flags: DataFrame, concealed: DataFrame) -> DataFrame:
    """Flags and concealed items as doc, field, seq, anchor, quote."""
    return flags.select("doc", F.lit("flag").alias("field"), "seq", "anchor", "quote").unionByName(concealed.select("doc", F.lit("concealed").alias("field"), "seq", "anchor", "quote"))


def timeline(said: DataFrame, docs: DataFrame) -> DataFrame:
    """Dated statements (doc, quote, anchor), each once: day (in the quote, else the document's (doc, day), else none), doc, quote, anchor, place."""
    day = F.coalesce(F.get(days_in(F.col("quote")), F.lit(0)), F.col("own"), F.lit("9999-99-99"))
    dated = said.join(docs.select("doc", F.col("day").alias("own")), "doc", "left").select(day.alias("day"), "doc", R.quoted(F.col("quote")).alias("quote"), "anchor").distinct()
    return dated.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("day", "anchor", "quote")))


def shared_names(references: DataFrame, inside: DataFrame, least: int = 2) -> DataFrame:
    """Codes, names and tickets that several documents of the set refer to, first reference of each: value, doc, seq, quote, anchor."""
    own = references.where("kind in ('code', 'name', 'ticket')").join(inside, "doc", "left_semi")
    several = own.groupBy("value").agg(F.countDistinct("doc").alias("n")).where(F.col("n") >= least).select("value")
    first = own.join(several, "value", "left_semi").groupBy("value", "doc").agg(F.min(F.struct("seq", "quote", "anchor")).alias("x"))
    return first.select("value", "doc", "x.seq", "x.quote", "x.anchor")


def lesser(flagged: DataFrame, inside: DataFrame) -> DataFrame:
    """Flagged documents (room, doc, surface) outside their room's set (room, doc), by their largest money: room, doc, money, place."""
    money = flagged.join(inside, ["room", "doc"], "left_anti").groupBy("room", "doc").agg(F.max(money_value(F.col("surface"))).alias("money"))
    return money.withColumn("place", F.row_number().over(Window.partitionBy("room").orderBy(F.desc_nulls_last("money"), "doc")))


def warranties(flags: DataFrame) -> DataFrame:
    """Warranties held against reservations of other documents, a matter (matter, doc, seq, quote, anchor) at a time.

    A warranty has a negation beside a word of materiality; a reservation says that materiality is
    not settled.  The two lists of a matter meet by the matter alone, so they should be short.
    """
    says = lambda p: F.col("quote").rlike(rf"(?i)\b(?:{p})")
    held = flags.where(says(r"(?:no|not|never|nor)\b") & says("material") & ~says(r"materiality\b"))
    open_ = flags.where(says(r"materiality\b") & says(r"(?:determinable|undetermined|premature|deferred|pending)\b"))
    side = lambda df, p: df.select("matter", F.col("doc").alias(f"{p}_doc"), F.col("quote").alias(f"{p}_quote"), F.col("anchor").alias(f"{p}_anchor"))
    return side(held, "said").join(side(open_, "open"), "matter").where("said_doc <> open_doc")


def unique_title_words(titles: DataFrame) -> DataFrame:
    """Words (doc, words) that one document's title alone has: doc, word."""
    words = titles.select("doc", F.explode(F.array_distinct("words")).alias("word"))
    return words.groupBy("word").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("doc")).where("n = 1").select("doc", "word")


def worried_about(unique: DataFrame, flags: DataFrame) -> DataFrame:
    """Documents that another one's flags (doc, words) name by a word of their title alone: doc."""
    said = flags.select(F.col("doc").alias("by"), F.explode(F.array_distinct("words")).alias("word"))
    return unique.join(said, "word").where("doc <> by").select("doc").distinct()
