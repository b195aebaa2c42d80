"""The digest of a dossier, a budget of rows dealt over its sections, and the schedule of evidence.

A dossier is lines: dossier, matter (from 1), section, place, line.  Many dossiers are worked out
side by side; every choice is a rank within a dossier's matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rows as R
from tessera.operators.typed_index import WRITTEN_AMOUNT, amount_parts

# Rows that a digest keeps of the first matter and of a further one, and of its sections.
DIGEST_ROWS, FURTHER_ROWS = 150, 45
TIMELINE_ROWS, MONEY_ROWS, TERM_ROWS, LESSER_ROWS = 60, 40, 20, 6
# Sections in the order in which a digest and a schedule write them.
DIGEST_SECTIONS = ("Timeline", "Names", "Figures", "Models blind to it", "Comparisons", "Lesser matters")
EVIDENCE_SECTIONS = ("Timeline", "Names", "Figures", "Models blind to it")
# Weights of rows that set a document against another, carry a blind model, or write a name.
WEIGHTS = {"Comparisons": 3, "Models blind to it": 3, "Names": 1}
# Longest schedule in characters, and the shortest quote that says something when it has to be cut.
EVIDENCE_CHARS, EVIDENCE_QUOTE = 120_000, 25
# Words of a turning point, and how terms, ids, periods and counts are written.
STATUS_WORDS = ("draft", "final", "redacted", "privileged", "reclassified", "blocked", "exceeds", "exception", "notice", "terminate", "reserve", "probable", "determinable", "material")
TERM, DOCUMENT_ID = r"\b[A-Z][A-Z0-9_-]{2,}\b", r"\b[A-Z]{2,3}-[0-9]{2,4}\b"
MONEY, PERCENT = r"[$£€]\s?[0-9]", r"[0-9]\s?%"
PERIOD = r"(?i)\b[0-9]+[- ]?(?:day|days|month|months|year|years)\b"
COUNT_WITH_UNIT = r"(?i)[0-9][0-9,.]*\s?-?\s?(?:m|months|day|days)\b"
# What a digest writes under the heading of a further matter.
FURTHER_NOTE = "A second matter of the same room, smaller than the matter above. Write its rows under the report's own `## The second matter` heading, which stands after the first matter's three sections and before the lesser issues, and do not mix them into the first matter's sections."

_KEYS = ["dossier", "matter"]


def turning_signals(line: Column) -> Column:
    """Marks of a turning point in a row's quote: different terms in capitals that are no ids, money, a percentage, a period, status words."""
    quote = R.row_quote(line)
    terms = F.size(F.array_except(F.regexp_extract_all(quote, F.lit(TERM), 0), F.regexp_extract_all(quote, F.lit(DOCUMENT_ID), 0)))
    marks = sum((quote.rlike(p).cast("int") for p in (MONEY, PERCENT, PERIOD)), F.lit(0))
    return terms + marks + sum((F.lower(quote).contains(w).cast("int") for w in STATUS_WORDS), F.lit(0))


def is_turning_point(line: Column) -> Column:
    return turning_signals(line) > 0


def money_of(field: Column) -> Column:
    """The dollar value of a field that writes money; else null."""
    value, _ = amount_parts(F.regexp_extract(field, WRITTEN_AMOUNT, 0))
    return F.when(field.rlike(MONEY), value)


def is_money_figure(line: Column) -> Column:
    return money_of(F.get(R.row_fields(line), F.lit(0))).isNotNull()


def weights(lines: DataFrame) -> DataFrame:
    """What each document weighs in a matter's comparisons, blind models and names: dossier, matter, doc, weight."""
    own = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    docs = F.when(F.col("section") == "Comparisons", R.comparison_documents(F.col("line"))).otherwise(F.array(R.row_document(F.col("line"))))
    rows = lines.where(F.col("section").isin(*WEIGHTS)).select(*_KEYS, own[F.col("section")].alias("w"), F.explode(docs).alias("doc"))
    return rows.where("doc <> ''").groupBy(*_KEYS, "doc").agg(F.sum("w").alias("weight"))


def _ranked(rows: DataFrame, *order: Column | str, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*_KEYS, *by).orderBy(*order)))


def _section(lines: DataFrame, name: str) -> DataFrame:
    return lines.where(F.col("section") == name).select(*_KEYS, "place", "line")


def _named(lines: DataFrame) -> DataFrame:
    """One row a name: the first that can be quoted, or the first, in the dossier's order."""
    rows = _section(lines, "Names").withColumn("name", F.get(R.row_fields(F.col("line")), F.lit(0)))
    return _ranked(rows, ~R.is_quotable(F.col("line")), "place", by=("name",)).where("rank = 1").select(*_KEYS, "place", "line")


def _lesser(lines: DataFrame, weighed: DataFrame) -> DataFrame:
    """The first matter's largest lesser rows, and all of documents that the matter does not weigh."""
    rows = _ranked(_section(lines, "Lesser matters").where("matter = 1"), ~R.is_quotable(F.col("line")), "place").withColumn("doc", R.row_document(F.col("line")))
    held = rows.join(weighed.select(*_KEYS, "doc", F.lit(True).alias("held")), [*_KEYS, "doc"], "left")
    return held.where((F.col("rank") <= LESSER_ROWS) | F.col("held").isNull()).select(*_KEYS, F.col("rank").alias("place"), "line")


def _timeline(lines: DataFrame, weighed: DataFrame, caps: DataFrame) -> DataFrame:
    """Turning points of weighed documents in turns, heaviest first, within the matter's cap, then by day.

    A document offers for each of its days that day's strongest row, days that say most first, and
    its strongest rows of all, in turns.
    """
    line = F.col("line")
    rows = _section(lines, "Timeline").select(*_KEYS, "place", "line", R.row_document(line).alias("doc"), F.get(R.row_fields(line), F.lit(0)).alias("day"), R.is_quotable(line).alias("short"), turning_signals(line).alias("signals"))
    rows = rows.groupBy(*_KEYS, "doc", "line", "day", "short", "signals").agg(F.min("place").alias("place")).join(weighed, [*_KEYS, "doc"])
    days = rows.groupBy(*_KEYS, "doc", "day").agg(F.sum("signals").alias("said"))
    days = days.withColumn("nth_day", F.row_number().over(Window.partitionBy(*_KEYS, "doc").orderBy(F.desc("said"), "day")))
    best = rows.withColumn("of_day", F.row_number().over(Window.partitionBy(*_KEYS, "doc", "day").orderBy(F.desc("short"), F.desc("signals"), "place")))
    best = best.withColumn("strength", F.row_number().over(Window.partitionBy(*_KEYS, "doc").orderBy(F.desc("short"), F.desc("signals"), "place")))
    turn = F.least(F.when(F.col("of_day") == 1, 2 * F.col("nth_day")), 2 * F.col("strength") + 1)
    placed = best.join(days.select(*_KEYS, "doc", "day", "nth_day"), [*_KEYS, "doc", "day"]).withColumn("turn", turn)
    placed = placed.withColumn("depth", F.row_number().over(Window.partitionBy(*_KEYS, "doc").orderBy("turn")))
    picked = _ranked(placed, "depth", F.desc("weight"), "doc").join(caps, _KEYS).where("rank <= timeline_cap")
    return picked.select(*_KEYS, F.row_number().over(Window.partitionBy(*_KEYS).orderBy("day", "doc", "rank")).alias("place"), "line")


def _figures(lines: DataFrame, weighed: DataFrame, caps: DataFrame) -> DataFrame:
    """The largest money of the heaviest documents, then rows with a term or a count, each kind within its cap.

    Rows that can be quoted come alone where there are any.
    """
    line = F.col("line")
    rows = _section(lines, "Figures").select(*_KEYS, "place", "line", R.row_document(line).alias("doc"), R.is_quotable(line).alias("short"), money_of(F.get(R.row_fields(line), F.lit(0))).alias("value"), R.row_quote(line).alias("quote")).join(weighed, [*_KEYS, "doc"])
    rows = rows.withColumn("money", F.col("value").isNotNull()).where(F.col("money") | F.col("quote").rlike(TERM) | F.col("quote").rlike(COUNT_WITH_UNIT))
    any_short = F.max("short").over(Window.partitionBy(*_KEYS, "money"))
    rows = rows.withColumn("any_short", any_short).where("short or not any_short")
    ranked = _ranked(rows, F.desc("weight"), F.desc("value"), "place", by=("money",)).join(caps, _KEYS)
    kept = ranked.where(F.when(F.col("money"), F.col("rank") <= F.col("money_cap")).otherwise(F.col("rank") <= F.col("term_cap")))
    return kept.select(*_KEYS, F.row_number().over(Window.partitionBy(*_KEYS).orderBy(F.desc("money"), "rank")).alias("place"), "line")


def digest(lines: DataFrame, rows: int = DIGEST_ROWS, further: int = FURTHER_ROWS) -> DataFrame:
    """The rows that a digest keeps: dossier, matter, section, place, line.

    Names, blind models and comparisons go in whole and are charged first, with the first six
    lesser rows; the timeline takes what it may of the rest, and the figures what it leaves.
    """
    weighed, names = weights(lines), _named(lines)
    lesser = _lesser(lines, weighed)
    models = _section(lines, "Models blind to it")
    comparisons = _ranked(_section(lines, "Comparisons"), ~R.is_quotable(F.col("line")), "place").select(*_KEYS, F.col("rank").alias("place"), "line")
    counted = lambda df, name: df.groupBy(*_KEYS).agg(F.count("*").alias(name))
    sizes = lines.select(*_KEYS).distinct()
    for name, df in (("n_names", names), ("n_models", models), ("n_comparisons", comparisons), ("n_lesser", lesser), ("n_weighed", weighed)):
        sizes = sizes.join(counted(df, name), _KEYS, "left").fillna(0, [name])
    cap = F.when(F.col("matter") == 1, rows).otherwise(further)
    room = F.greatest(cap - F.col("n_names") - F.least(F.lit(LESSER_ROWS), F.col("n_lesser")) - F.col("n_models") - F.col("n_comparisons"), F.lit(0))
    caps = sizes.withColumn("room", room).withColumn("timeline_cap", F.least("room", F.greatest("n_weighed", F.least(F.lit(TIMELINE_ROWS), F.expr("room * 2 div 3")))))
    timeline = _timeline(lines, weighed, caps.select(*_KEYS, "timeline_cap"))
    left = caps.join(counted(timeline, "n_timeline"), _KEYS, "left").fillna(0, ["n_timeline"]).withColumn("left", F.greatest(F.col("room") - F.col("n_timeline"), F.lit(0)))
    left = left.select(*_KEYS, F.least(F.lit(MONEY_ROWS), "left").alias("money_cap"), "left").withColumn("term_cap", F.least(F.lit(TERM_ROWS), F.col("left") - F.col("money_cap"))).drop("left")
    found = {"Timeline": timeline, "Names": names, "Figures": _figures(lines, weighed, left), "Models blind to it": models, "Comparisons": comparisons, "Lesser matters": lesser}
    out = None
    for name in DIGEST_SECTIONS:
        own = found[name].select(*_KEYS, F.lit(name).alias("section"), F.col("place").cast("int").alias("place"), "line")
        out = own if out is None else out.unionByName(own)
    return out


def _joined(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Lines of each key joined in order: keys, text."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias("text"))


def digest_markdown(kept: DataFrame) -> DataFrame:
    """The digest of each dossier as one text: dossier, text.  Sections without rows are left out, and so are their headings."""
    number = F.create_map(*(F.lit(x) for k, name in enumerate(DIGEST_SECTIONS) for x in (name, k)))
    sections = _joined(kept, [*_KEYS, "section"], "place").select(*_KEYS, number[F.col("section")].alias("k"), F.concat(F.lit("### "), "section", F.lit("\n\n"), "text", F.lit("\n")).alias("line"))
    matters = _joined(sections, _KEYS, "k")
    head = F.when(F.col("matter") > 1, F.concat(F.lit("## Matter "), F.col("matter").cast("string"), F.lit(f"\n\n{FURTHER_NOTE}\n\n"))).otherwise("")
    whole = _joined(matters.select("dossier", "matter", F.concat(head, "text").alias("line")), ["dossier"], "matter")
    return whole.select("dossier", F.concat(F.lit("# Digest\n\n"), F.rtrim(F.regexp_replace("text", r"\n+$", "")), F.lit("\n")).alias("text"))


def evidence(lines: DataFrame, most: int = EVIDENCE_CHARS) -> DataFrame:
    """The schedule of each dossier within reach: dossier, cut, text.

    Under each document of a matter its timeline, names, figures and blind models, a line each and
    each once; then comparisons and lesser matters.  Cut 1 leaves out figures that are not money, cut 2
    timeline lines too short to say anything too; the first cut whose schedule fits is taken,
    else the last.  Sizes are summed before any text is made.
    """
    line = F.col("line")
    rest = F.split(F.regexp_replace(line, r"^- [^.]*\. ", ""), r" \| ")
    heads = lines.where("section = 'Documents'").select(*_KEYS, F.col("place").alias("rank"), F.get(rest, F.lit(0)).alias("doc"), F.concat(F.lit("### "), F.concat_ws(" | ", F.get(rest, F.lit(0)), F.coalesce(F.get(rest, F.lit(1)), F.lit("")), F.coalesce(F.get(rest, F.lit(3)), F.lit("-")))).alias("head")).where("doc <> ''")
    number = F.create_map(*(F.lit(x) for k, name in enumerate(EVIDENCE_SECTIONS) for x in (name, k)))
    # A row is in the schedules of the cuts below the one that leaves it out.
    cuts = F.when((F.col("section") == "Figures") & ~is_money_figure(line), F.array(F.lit(0))).when((F.col("section") == "Timeline") & (F.length(R.row_quote(line)) < EVIDENCE_QUOTE), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    rows = lines.where(F.col("section").isin(*EVIDENCE_SECTIONS)).select(*_KEYS, number[F.col("section")].alias("k"), "place", R.row_document(line).alias("doc"), R.evidence_line(line).alias("line"), F.explode(cuts).alias("cut"))
    rows = rows.groupBy("cut", *_KEYS, "doc", "line").agg(F.min(F.struct("k", "place")).alias("at"))
    rows = rows.join(heads, [*_KEYS, "doc"])
    tops = rows.select("cut", *_KEYS, "rank", "head").distinct().select("cut", *_KEYS, F.lit(0).alias("part"), "rank", F.lit(0).alias("nth"), F.struct(F.lit(-1).alias("k"), F.lit(0).alias("place")).alias("at"), F.concat("head", F.lit("\n")).alias("line"))
    # The last line of a block is followed by an empty one.
    last = F.row_number().over(Window.partitionBy("cut", *_KEYS, "rank").orderBy(F.desc("at")))
    body = rows.withColumn("last", last).select("cut", *_KEYS, F.lit(0).alias("part"), "rank", F.lit(1).alias("nth"), F.struct(F.col("at.k").alias("k"), F.col("at.place").cast("int").alias("place")).alias("at"), F.when(F.col("last") == 1, F.concat("line", F.lit("\n"))).otherwise(F.col("line")).alias("line"))
    ends = []
    for part, (name, written) in enumerate((("Comparisons", R.comparison_line), ("Lesser matters", R.evidence_line)), 1):
        own = _section(lines, name).withColumn("line", written(line))
        whole = own.withColumn("last", F.row_number().over(Window.partitionBy(*_KEYS).orderBy(F.desc("place"))))
        first = own.select(*_KEYS).distinct().select(*_KEYS, F.lit(0).alias("place"), F.lit(f"### {name}\n").alias("line"))
        both = first.unionByName(whole.select(*_KEYS, F.col("place").cast("int").alias("place"), F.when(F.col("last") == 1, F.concat("line", F.lit("\n"))).otherwise(F.col("line")).alias("line")))
        ends.append(both.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cut"), *_KEYS, F.lit(part).alias("part"), F.lit(0).alias("rank"), F.lit(1).alias("nth"), F.struct(F.lit(0).alias("k"), F.col("place").alias("place")).alias("at"), "line"))
    typed = lambda df: df.select("cut", *_KEYS, "part", F.col("rank").cast("int").alias("rank"), "nth", "at", "line")
    every = typed(tops).unionByName(typed(body)).unionByName(typed(ends[0])).unionByName(typed(ends[1]))
    later = every.where("matter > 1").select("cut", *_KEYS).distinct().select("cut", *_KEYS, F.lit(-1).alias("part"), F.lit(0).alias("rank"), F.lit(0).alias("nth"), F.struct(F.lit(0).alias("k"), F.lit(0).alias("place")).alias("at"), F.concat(F.lit("### Matter "), F.col("matter").cast("string"), F.lit("\n")).alias("line"))
    every = every.unionByName(later)
    # Line ends count too; of the empty line at the end one stays.
    sizes = every.groupBy("dossier", "cut").agg((F.sum(F.length("line") + 1) - 1).alias("chars"))
    chosen = sizes.groupBy("dossier").agg(F.coalesce(F.min(F.when(F.col("chars") <= most, F.col("cut"))), F.max("cut")).alias("cut"))
    text = _joined(every.join(chosen, ["dossier", "cut"]), ["dossier", "cut"], "matter", "part", "rank", "nth", "at")
    return text.select("dossier", "cut", F.concat(F.regexp_replace("text", r"\n+$", ""), F.lit("\n")).alias("text"))
