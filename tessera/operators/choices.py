"""What readers chose from a room: findings by document, notes of chosen documents, recall, rubrics, prices.

Findings are room, group, place (within the group), doc, finding, quote, anchor.  Rooms are worked
out side by side; nodes are room, doc, place (the room's order), title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapsed
from tessera.functions.words import fold, word_runs
from tessera.operators import contained
from tessera.operators.ranking import within_budget

#: Rows that all groups of a room keep together.
ROWS = 150


def _field(text: Column) -> Column:
    """A text as a field of a row: one line, bars as slashes, a hyphen for nothing."""
    plain = F.replace(collapsed(F.coalesce(text, F.lit(""))), F.lit("|"), F.lit("/"))
    return F.when(plain == "", "-").otherwise(plain)


def unquoted(text: Column) -> Column:
    """One line without quotation marks and spaces at its ends."""
    return F.regexp_replace(collapsed(F.coalesce(text, F.lit(""))), "^[\"'“”‘’ ]+|[\"'“”‘’ ]+$", "")


def group_cap(groups: Column, rows: int = ROWS) -> Column:
    """The findings that one of so many groups keeps: the rows shared out, rounded up."""
    return F.ceil(F.lit(float(rows)) / groups).cast("int")


def document_parts(counts: DataFrame, rows: int) -> DataFrame:
    """Documents (room, place, doc, n) in consecutive parts whose findings sum to so many at most: room, place, doc, part.  A larger document is alone."""
    parts = within_budget(counts.select("room", "place", F.col("n").alias("size")), rows)
    return counts.join(parts, ["room", "place"]).select("room", "place", "doc", F.col("group").alias("part"))


def unseen(findings: DataFrame, seen: DataFrame) -> DataFrame:
    """Findings whose quote the text that their room has seen (room, text) does not hold, white space aside.

    A room's text is one row and is read for all its findings together.
    """
    asked = findings.withColumn("sought", unquoted(F.col("quote")))
    texts = seen.select("room", collapsed(F.col("text")).alias("text"))
    found = contained.held(asked.select("room", F.col("sought").alias("quote")), texts)
    return asked.join(found.select("room", F.col("quote").alias("sought")), ["room", "sought"], "left_anti").select(*findings.columns)


def by_document(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings with their document's number among those that have any, in the room's order, and their own place in it: rank, at."""
    own = findings.join(nodes.select("room", "doc", F.col("place").alias("order"), "title"), ["room", "doc"])
    rank = F.dense_rank().over(Window.partitionBy("room").orderBy("order", "doc"))
    at = F.row_number().over(Window.partitionBy("room", "doc").orderBy("group", "place"))
    return own.withColumn("rank", rank).withColumn("at", at).drop("order")


def _lines(rows: DataFrame) -> DataFrame:
    """One text for each room from lines (room, part, rank, at, line): room, text."""
    lines = rows.groupBy("room").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "rank", "at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return lines.select("room", F.concat(F.regexp_replace("text", r"\n+$", ""), F.lit("\n")).alias("text"))


def _heads(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list of documents (room, rank, doc, title), and a heading for each, as lines."""
    title = F.concat_ws(" | ", "doc", _field(F.coalesce("title", "doc")))
    number = F.col("rank").cast("string")
    last = F.max("rank").over(Window.partitionBy("room"))
    listed = docs.select("room", F.lit(1).alias("part"), "rank", F.lit(0).alias("at"), F.concat(F.lit("- "), number, F.lit(". "), title, F.lit(" | - | - | -"), F.when(F.col("rank") == last, "\n").otherwise("")).alias("line"))
    return listed, docs.select("room", F.lit(2).alias("part"), "rank", F.lit(0).alias("at"), F.concat(F.lit("### "), number, F.lit(". "), title, F.lit("\n")).alias("line"))


def _closed(rows: DataFrame) -> DataFrame:
    """Lines of documents (room, rank, at, line), the last of each followed by an empty one."""
    last = F.max("at").over(Window.partitionBy("room", "rank"))
    return rows.select("room", F.lit(2).alias("part"), "rank", "at", F.when(F.col("at") == last, F.concat("line", F.lit("\n"))).otherwise(F.col("line")).alias("line"))


def findings_digest(found: DataFrame, head: str) -> DataFrame:
    """Findings by document (room, rank, at, doc, title, finding, quote, anchor) as one text for each room: room, text."""
    row = F.concat(F.lit("- "), F.concat_ws(" | ", _field(F.col("finding")), "doc", unquoted(F.col("quote")), "anchor"))
    listed, heads = _heads(found.select("room", "rank", "doc", "title").distinct())
    top = found.select("room").distinct().select("room", F.lit(0).alias("part"), F.lit(0).alias("rank"), F.lit(0).alias("at"), F.lit(f"# Digest\n\n{head}\n\n### Documents\n").alias("line"))
    return _lines(top.unionByName(listed).unionByName(heads).unionByName(_closed(found.select("room", "rank", "at", row.alias("line")))))


def findings_evidence(found: DataFrame) -> DataFrame:
    """The quotes of findings by document, a line each and each once, ending in its citation, as one text for each room: room, text."""
    line = F.concat(F.lit("- "), _field(F.col("finding")), F.lit(' | "'), unquoted(F.col("quote")), F.lit('" | ['), "doc", F.lit(" | "), "anchor", F.lit("]"))
    rows = found.select("room", "rank", "at", "doc", "title", line.alias("line")).groupBy("room", "rank", "doc", "title", "line").agg(F.min("at").alias("at"))
    heads = rows.select("room", "rank", "doc", "title").distinct().select("room", F.lit(2).alias("part"), "rank", F.lit(0).alias("at"), F.concat(F.lit("### "), F.concat_ws(" | ", "doc", _field(F.coalesce("title", "doc"))), F.lit("\n")).alias("line"))
    return _lines(heads.unionByName(_closed(rows.select("room", "rank", "at", "line"))))


def chosen_items(chosen: DataFrame, flags: DataFrame, figures: DataFrame) -> DataFrame:
    """The notes of chosen documents (room, doc, rank, title) as findings: flags with what follows from them, then figures."""
    said = F.concat(_field(F.col("flag")), F.lit(" Consequence: "), _field(F.col("consequence")))
    rows = flags.select("doc", F.lit(0).alias("k"), "seq", said.alias("finding"), "quote", "anchor").unionByName(figures.select("doc", F.lit(1).alias("k"), "seq", F.col("surface").alias("finding"), "quote", "anchor"))
    own = chosen.join(rows, "doc")
    return own.withColumn("at", F.row_number().over(Window.partitionBy("room", "doc").orderBy("k", "seq"))).select("room", "rank", "at", "doc", "title", "finding", "quote", "anchor")


def planted_recall(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Whether an item (doc, quote) of a note of one of a fact's own documents (fact, value, documents) quotes it, folded: fact, hit."""
    wanted = facts.select("fact", fold(F.col("value")).alias("wanted"), F.explode_outer("documents").alias("doc"))
    met = wanted.join(items.select("doc", fold(F.col("quote")).alias("said")).distinct(), "doc", "left")
    return met.groupBy("fact").agg(F.coalesce(F.max(F.contains("said", "wanted")), F.lit(False)).alias("hit"))


def rubric_rows(replies: DataFrame, rubric: DataFrame) -> DataFrame:
    """A grader's reply (report, text) read against the rubric (id, points): report, id, points (within the row's band), reason.

    The list stands between the first and the last square bracket; rows it leaves out have no points.  A reply
    without a list has no rows.
    """
    listed = F.regexp_extract("text", r"(?s)(\[.*\])", 1)
    scored = replies.select("report", F.from_json(listed, "array<struct<id: int, points: double, reason: string>>").alias("rows")).where("rows is not null")
    given = scored.select("report", F.explode("rows").alias("r")).select("report", "r.*").groupBy("report", "id").agg(F.last("points").alias("got"), F.last("reason").alias("reason"))
    # A key's rubric is a few rows for every report.
    every = scored.select("report").join(F.broadcast(rubric.limit(10_000)), F.lit(True))
    points = F.greatest(F.lit(0), F.least(F.coalesce(F.col("got").cast("int"), F.lit(0)), F.col("points")))
    told = F.when(F.coalesce("reason", F.lit("")) == "", "no reason given").otherwise(F.col("reason"))
    return every.join(given, ["report", "id"], "left").select("report", "id", points.alias("points"), told.alias("reason"))


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls (id, model, tokens_in, tokens_out) at the rates of a million tokens (model, rate_in, rate_out): id, dollars; null for a model without a rate."""
    dollars = (F.col("tokens_in") * F.col("rate_in") + F.col("tokens_out") * F.col("rate_out")) / 1_000_000
    return calls.join(F.broadcast(prices.limit(10_000)), "model", "left").select("id", dollars.alias("dollars"))


def named_in_pieces(named: DataFrame, pieces: DataFrame) -> DataFrame:
    """Named values (doc, seq, value) that a piece of their document (doc, piece, text) writes, folded: doc, piece, seq, value."""
    met = named.withColumn("form", fold(F.col("value"))).where("form <> ''").join(pieces.select("doc", "piece", fold(F.col("text")).alias("said")), "doc")
    return met.where(F.contains("said", "form")).select("doc", "piece", "seq", "value")


def naming_runs(runs: DataFrame, values: DataFrame) -> DataFrame:
    """Runs of words (id, run) that hold a value (value) that notes write: id."""
    return runs.select("id", F.explode(word_runs(F.col("run"))).alias("value")).join(values.select("value").distinct(), "value", "left_semi").select("id").distinct()
