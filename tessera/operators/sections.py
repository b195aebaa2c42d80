"""Lines, blocks, headings and line tables of texts, by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import NUMBERED_HEADING, PLAIN_NUMBER


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line (from 1), text."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "text")).select("doc", (F.col("pos") + 1).cast("long").alias("line"), "text")


def blocks(of_lines: DataFrame) -> DataFrame:
    """Maximal runs of lines that are not blank: doc, line (the first), n_lines, text."""
    blank = F.trim("text") == ""
    island = F.sum(blank.cast("int")).over(Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    runs = of_lines.withColumn("island", island).where(~blank).groupBy("doc", "island")
    return runs.agg(F.min("line").alias("line"), F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("own")).select("doc", "line", "n_lines", F.array_join("own.text", "\n").alias("text"))


def is_heading(text: F.Column) -> F.Column:
    """A single numbered line, or a single one in capitals with four letters or more."""
    return ~F.contains(text, F.lit("\n")) & (text.rlike(NUMBERED_HEADING) | (text.rlike("[A-Z].*[A-Z].*[A-Z].*[A-Z]") & ~text.rlike("[a-z]")))


def headed(sections: DataFrame, at: str = "line") -> DataFrame:
    """With the heading in force: the latest one so far, itself included."""
    window = Window.partitionBy("doc").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn("heading", F.last(F.when(is_heading(F.col("text")), F.col("text")), ignorenulls=True).over(window))


def front_matter(sections: DataFrame, at: str = "line", most: int = 10) -> DataFrame:
    """Leading sections before the first heading or table row, at most so many."""
    window = Window.partitionBy("doc").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.when(is_heading(F.col("text")) | is_line_row(F.col("text")), 1).otherwise(0)).over(window)
    return sections.withColumn("stop", stop).withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy(at))).where((F.col("stop") == 0) & (F.col("n") <= most)).drop("stop")


def is_line_row(text: F.Column) -> F.Column:
    """A row of a line table: one line with ` | `, or one number."""
    return ~F.contains(text, F.lit("\n")) & (F.contains(text, F.lit(" | ")) | F.trim(text).rlike(PLAIN_NUMBER))


def line_runs(of_lines: DataFrame) -> DataFrame:
    """Rows of maximal runs of consecutive line rows that hold a ` | `: doc, run (its first line), line, text."""
    rows = of_lines.where(is_line_row(F.col("text"))).withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy("doc").orderBy("line")))
    whole = Window.partitionBy("doc", "island")
    return rows.select("doc", F.min("line").over(whole).alias("run"), "line", "text", F.max(F.contains("text", F.lit(" | "))).over(whole).alias("barred")).where("barred").drop("barred")


def line_cells(rows: DataFrame) -> DataFrame:
    """Cells of line rows: doc, run, line, cell (from 1), text, number (null if it is none)."""
    cells = rows.select("doc", "run", "line", F.posexplode(F.split("text", r" \| ")).alias("cell", "text"))
    number = F.when(F.trim("text").rlike(PLAIN_NUMBER), F.replace(F.trim("text"), F.lit(","), F.lit("")).cast("double"))
    return cells.select("doc", "run", "line", (F.col("cell") + 1).cast("int").alias("cell"), "text", number.alias("number"))


def table_headers(cells: DataFrame) -> DataFrame:
    """For each run, the last row without a number above its first row with one: doc, run, line, cell, text."""
    first = cells.where("number is not null").groupBy("doc", "run").agg(F.min("line").alias("first"))
    plain = cells.groupBy("doc", "run", "line").agg(F.max(F.col("number").isNotNull()).alias("numeric")).where("not numeric")
    header = plain.join(first, ["doc", "run"]).where("line < first").groupBy("doc", "run").agg(F.max("line").alias("line"))
    return cells.join(header, ["doc", "run", "line"]).select("doc", "run", "line", "cell", "text")


def packed_pieces(sections: DataFrame, limit: int, order: str = "line") -> DataFrame:
    """Sections dealt in order into pieces of at most `limit` characters, joined by one
    newline; a longer section is a piece of its own.  doc, piece (from 1), first, last,
    n_sections, chars.
    """
    # The fold runs within one document's row; a document's sections are bounded by its text.
    own = sections.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.length("text").cast("long").alias("n")))).alias("own"))
    start = "cast(array() as array<struct<first: bigint, last: bigint, n_sections: bigint, chars: bigint>>)"
    fold = f"""aggregate(own, {start}, (done, s) -> case
        when size(done) > 0 and element_at(done, -1).chars + 1 + s.n <= {limit} then concat(slice(done, 1, size(done) - 1),
          array(struct(element_at(done, -1).first as first, s.at as last, element_at(done, -1).n_sections + 1 as n_sections, element_at(done, -1).chars + 1 + s.n as chars)))
        else concat(done, array(struct(s.at as first, s.at as last, cast(1 as bigint) as n_sections, s.n as chars))) end)"""
    return own.select("doc", F.posexplode(F.expr(fold)).alias("piece", "p")).select("doc", (F.col("piece") + 1).cast("long").alias("piece"), "p.first", "p.last", "p.n_sections", "p.chars")
