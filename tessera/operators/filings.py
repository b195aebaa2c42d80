"""Filings in markdown, split at headings into parts of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.words import slug

# The longest heading, the longest part, the name of what stands before the first heading.
HEADING_LIMIT, PART_LIMIT, FRONT = 150, 40_000, "front matter"
# How numbered headings begin, and what draws a line only.
NUMBERED = r"(?i)^(?:Item\s+[0-9]+[A-Z]?|(?:Article|Part)\s+(?:[IVXLCDM]+|[0-9]+))\b"
RULE = r"^[\s|:-]+$"


def clean(text: Column) -> Column:
    """One line without markdown marks, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[*_`#\\]", ""), r"[\s ]+", " "))


def heading(line: Column) -> Column:
    """The heading that a line opens: a numbered item, article or part, or a line in capitals; else null.

    A row of a table is one only if it is numbered and no cell of it is a bare number.
    """
    table = line.contains("|")
    cells = F.filter(F.transform(F.split(line, r"\|"), clean), lambda c: c != "")
    text = F.array_join(cells, " ")
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    fits = (text != "") & (F.length(text) <= HEADING_LIMIT) & ~line.rlike(RULE) & ~(table & F.exists(cells, lambda c: c.rlike("^[0-9]+$")))
    return F.when(fits & (text.rlike(NUMBERED) | ~table & (letters >= 4) & ~text.rlike("[a-z]")), text)


def parts(lines: DataFrame) -> DataFrame:
    """Parts of documents (doc, line, text) from heading to heading: doc, part, heading, text; blank ones go."""
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("opens", heading(F.col("text"))).withColumn("part", F.count("opens").over(w)).withColumn("heading", F.coalesce(F.last("opens", ignorenulls=True).over(w), F.lit(FRONT)))
    whole = own.groupBy("doc", "part").agg(F.first("heading").alias("heading"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.withColumn("text", F.concat(F.regexp_replace("text", r"^\n+|\n+\z", ""), F.lit("\n"))).where(~F.col("text").rlike(r"^\s*\z"))


def has_text(text: Column, title: Column) -> Column:
    """A part has a line of its own below its first: not blank, no rule, not its heading again."""
    below = F.slice(F.split(text, "\n"), 2, 1 << 30)
    return F.exists(below, lambda line: (F.trim(line) != "") & ~line.rlike(RULE) & (clean(line) != title))


def folded(of: DataFrame) -> DataFrame:
    """Parts without text of their own joined to the next one that has some, the last ones to the one before: doc, part, heading, text."""
    w = Window.partitionBy("doc").orderBy("part")
    own = of.withColumn("has", (has_text(F.col("text"), F.col("heading")) | (F.col("heading") == FRONT)).cast("int"))
    own = own.withColumn("before", F.coalesce(F.sum("has").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("has").over(Window.partitionBy("doc")))
    own = own.withColumn("into", F.greatest(F.least("before", F.col("total") - 1), F.lit(0)))
    found = own.groupBy("doc", "into").agg(F.coalesce(F.max(F.when(F.col("has") == 1, F.col("heading"))), F.lit(FRONT)).alias("heading"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"))
    return found.select("doc", F.col("into").alias("part"), "heading", "text")


def _filled(pieces: str, limit: int) -> str:
    """SQL that fills strings of at most `limit` characters with pieces, in order."""
    return f"""aggregate({pieces}, cast(array() as array<string>), (done, s) -> case
        when size(done) > 0 and length(element_at(done, -1)) + length(s) <= {limit} then concat(slice(done, 1, size(done) - 1), array(concat(element_at(done, -1), s)))
        else concat(done, array(s)) end)"""


def split_long(of: DataFrame, limit: int = PART_LIMIT) -> DataFrame:
    """Parts longer than the limit cut between paragraphs, a longer paragraph between lines, a longer line anywhere: doc, part, piece, heading, text."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?:[^\S\n]*\n)*(?:[^\n]*\S[^\n]*(?:\n|\z))+(?:[^\S\n]*(?:\n|(?<=[^\S\n])\z))*"), 0)
    lines = "regexp_extract_all(b, '[^\\n]*\\n|[^\\n]+', 0)"
    chunks = f"flatten(transform({lines}, l -> transform(sequence(0, cast((length(l) - 1) div {limit} as int)), i -> substring(l, i * {limit} + 1, {limit}))))"
    pieces = f"flatten(transform(blocks, b -> if(length(b) <= {limit}, array(b), {_filled(chunks, limit)})))"
    texts = F.when(F.length("text") <= limit, F.array("text")).otherwise(F.expr(_filled(pieces, limit)))
    cut = of.withColumn("blocks", blocks).select("doc", "part", "heading", F.posexplode(texts).alias("piece", "text"))
    return cut.select("doc", "part", "piece", F.when(F.col("piece") == 0, F.col("heading")).otherwise(F.concat("heading", F.lit(" (continued "), (F.col("piece") + 1).cast("string"), F.lit(")"))).alias("heading"), "text")


def split_filings(lines: DataFrame, limit: int = PART_LIMIT) -> DataFrame:
    """All of it, with the number and the file name of each part: doc, number, file, heading, text."""
    own = split_long(folded(parts(lines)), limit)
    number = F.row_number().over(Window.partitionBy("doc").orderBy("part", "piece"))
    name = F.when(slug(F.col("heading")) == "", "section").otherwise(slug(F.col("heading")))
    return own.withColumn("number", number).select("doc", "number", F.concat(F.lpad(F.col("number").cast("string"), 2, "0"), F.lit("-"), name, F.lit(".md")).alias("file"), "heading", "text")
