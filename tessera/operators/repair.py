"""Repairs of reports: parts put together, sentences replaced or taken out, findings added.

A report is one text (report, text).  Edits are folded into it in their order, so that each sees
what those before it left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sections of a report in order, and where a second matter's may stand.
HEADINGS = ("Executive summary", "Findings ranked by materiality", "The most material issue quantified", "Lesser issues", "Open items")
SECOND_HEADING, SECOND_PLACE = "The second matter", 3
EVIDENCE, LEFT_OUT, FURTHER = "Evidence", "Left out", "Further findings"
NUMBERED, ITEM_ONLY = r"^\s*[0-9]+[.)]\s+", r"^\s*(?:[-*+]|[0-9]+[.)])?\s*$"


def _after(text: Column, at: Column) -> Column:
    return F.substring(text, at, F.length(text))


def _no_end(text: Column) -> Column:
    return F.regexp_replace(text, r"\n+\z", "")


def replaced(text: Column, old: Column, new: Column) -> Column:
    """The text with the first occurrence of `old` written as `new`; without one, as it is."""
    at = F.instr(text, old)
    return F.when((old != "") & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), new, _after(text, at + F.length(old)))).otherwise(text)


def taken_out(text: Column, sentence: Column) -> Column:
    """The text without the first occurrence of a sentence, and without its line if only a list mark is left of it."""
    at = F.instr(text, sentence)
    before, behind = F.substring(text, F.lit(1), at - 1), _after(text, at + F.length(sentence))
    left, right = F.regexp_extract(before, r"([^\n]*)\z", 1), F.regexp_extract(behind, r"\A([^\n]*)", 1)
    head, tail = F.substring(before, F.lit(1), F.length(before) - F.length(left)), _after(behind, F.length(right) + 1)
    line = F.regexp_replace(F.regexp_replace(F.concat(left, right), r"\s+\z", ""), r"(?<=\S)  +", " ")
    # Without its line a text loses the line end too: the one behind it, or at the end of the text the one before.
    cut = F.when(tail == "", F.regexp_replace(head, r"\n\z", "")).when((head == "") & (tail == "\n"), "\n").otherwise(F.concat(head, _after(tail, F.lit(2))))
    return F.when((sentence == "") | (at == 0), text).when(line.rlike(ITEM_ONLY), cut).otherwise(F.concat(head, line, tail))


def apply_fixes(reports: DataFrame, listed: DataFrame, fixes: DataFrame) -> DataFrame:
    """Reports with their fixes: report, text.

    listed: report, n, sentence.  fixes: report, at (their order), n, sentence.  Each replaces the
    first place of the listed sentence of its number, or takes it out where it gives none; a
    number that is not listed, and a sentence that is no longer there, change nothing.
    """
    paired = fixes.select("report", "at", "n", F.trim(F.coalesce("sentence", F.lit(""))).alias("new")).join(listed.select("report", "n", F.col("sentence").alias("old")), ["report", "n"])
    folded = paired.groupBy("report").agg(F.sort_array(F.collect_list(F.struct("at", "n", "old", "new"))).alias("edits"))
    step = lambda text, e: F.when(F.instr(text, e["old"]) == 0, text).when(e["new"] == "", taken_out(text, e["old"])).otherwise(replaced(text, e["old"], e["new"]))
    joined = reports.join(folded, "report", "left")
    return joined.select("report", F.when(F.col("edits").isNull(), F.col("text")).otherwise(F.aggregate("edits", F.col("text"), step)).alias("text"))


def failing_sentences(failures: DataFrame) -> DataFrame:
    """Failing sentences once each, in their order, with all reasons: report, n, sentence, reasons.  failures: report, at, check, line, reason."""
    said = F.concat_ws(": ", "check", "reason")
    rows = failures.groupBy("report", "line").agg(F.min("at").alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", said.alias("said")))), lambda x: x["said"]), "; ").alias("reasons"))
    return rows.select("report", F.row_number().over(Window.partitionBy("report").orderBy("at")).alias("n"), F.col("line").alias("sentence"), "reasons")


def assembled(heads: DataFrame, parts: DataFrame) -> DataFrame:
    """Reports (report, text) with the lesser issues of all parts (report, part, text), numbered in turn, before the open items."""
    lines = parts.select("report", "part", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    heading = F.when(F.col("said").startswith("## "), F.trim(F.substring("said", F.lit(4), F.length("said"))))
    lines = lines.withColumn("under", F.last(heading, ignorenulls=True).over(Window.partitionBy("report", "part").orderBy("line"))).where((F.col("under") == HEADINGS[3]) & heading.isNull() & (F.trim("said") != ""))
    count = F.sum(F.col("said").rlike(NUMBERED).cast("int")).over(Window.partitionBy("report").orderBy("part", "line"))
    marked = F.when(F.col("said").rlike(NUMBERED), F.concat(F.col("count").cast("string"), F.lit(". "), F.regexp_replace("said", NUMBERED, ""))).otherwise(F.col("said"))
    items = lines.withColumn("count", count).groupBy("report").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "line", marked.alias("item")))), lambda x: x["item"]), "\n").alias("items"))
    joined = heads.join(items, "report", "left")
    lesser = F.concat(F.lit(f"## {HEADINGS[3]}\n\n"), F.coalesce("items", F.lit("")), F.lit("\n"))
    mark = f"\n## {HEADINGS[4]}"
    at = F.instr(F.col("text"), F.lit(mark))
    with_open = F.concat(_no_end(F.substring("text", F.lit(1), at - 1)), F.lit("\n\n"), lesser, F.lit("\n"), _after(F.col("text"), at + 1))
    return joined.select("report", F.when(at > 0, with_open).otherwise(F.concat(_no_end(F.col("text")), F.lit("\n\n"), lesser)).alias("text"))


def with_further(reports: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Reports with paragraphs (report, at, paragraph) at the end of their lesser issues, numbered on from the last: report, text."""
    own = paragraphs.groupBy("report").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "paragraph"))), lambda x: x["paragraph"]).alias("said"))
    joined = reports.join(own, "report", "left")
    shape = rf"(?s)\A(.*?(?:^|(?<=\n))## {HEADINGS[3]}[ \t]*(?:\n|\z))(.*?)((?:(?<=\n)## .*)?)\z"
    part = lambda k: F.regexp_extract("text", shape, k)
    body, rest = part(2), part(3)
    numbers = F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^\s*([0-9]+)\.\s"), 1), lambda x: x.cast("int"))
    first = F.coalesce(F.array_max(numbers), F.lit(0)) + 1
    items = F.array_join(F.transform("said", lambda p, k: F.concat((first + k).cast("string"), F.lit(". "), p)), "\n")
    kept = F.regexp_replace(F.concat(part(1), body), r"\s+\z", "")
    text = F.concat(kept, F.lit(f"\n\n### {FURTHER}\n\n"), items, F.lit("\n"), rest)
    return joined.select("report", F.when(F.col("said").isNotNull() & F.col("text").rlike(shape), text).otherwise(F.col("text")).alias("text"))


def with_left_out(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Reports with findings (report, at, finding, doc, anchor) listed under their own heading before the schedule: report, text."""
    flat = F.trim(F.regexp_replace("finding", r"\s+", " "))
    item = F.concat(flat, F.lit(" ["), "doc", F.lit(" | "), "anchor", F.lit("]"))
    own = findings.groupBy("report").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", item.alias("item")))), lambda x: x["item"]).alias("items"))
    joined = reports.join(own, "report", "left")
    lines = F.array_join(F.transform("items", lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x)), "\n")
    block = F.concat(F.lit(f"## {LEFT_OUT}\n\n"), lines, F.lit("\n\n"))
    shape = rf"(?s)\A(.*?)((?:\A|(?<=\n))## {EVIDENCE}[ \t]*(?:\n.*)?)\z"
    before, schedule = F.regexp_extract("text", shape, 1), F.regexp_extract("text", shape, 2)
    text = F.when(schedule != "", F.concat(_no_end(before), F.lit("\n\n"), block, schedule)).otherwise(F.concat(_no_end(F.col("text")), F.lit("\n\n"), block))
    return joined.select("report", F.when(F.col("items").isNull(), F.col("text")).otherwise(text).alias("text"))


def is_whole(text: Column) -> Column:
    """The sections that a model writes stand in their order at the head of a report, a second matter's in its place if it has one there."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^## (.*)$"), 1), lambda h: F.trim(h))
    plain = F.array(*(F.lit(h) for h in HEADINGS))
    second = F.array(*(F.lit(h) for h in (*HEADINGS[:SECOND_PLACE], SECOND_HEADING, *HEADINGS[SECOND_PLACE:])))
    has = F.array_contains(F.slice(found, 1, len(HEADINGS) + 1), SECOND_HEADING)
    return F.when(has, F.slice(found, 1, len(HEADINGS) + 1) == second).otherwise(F.slice(found, 1, len(HEADINGS)) == plain)
