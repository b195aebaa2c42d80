"""The dossier of a room: its matters' sets, comparisons, and the markdown made of them.

Matters are worked out side by side: clusters (matter, doc), seeds (matter, doc), ranked (matter, doc,
place), consequences (matter, kind, doc, series, period, figure, anchor), versions (matter, draft,
final).  Notes are as in `links`, flags with their flag text too; nodes are doc, path, folder, date,
status; sections doc, anchor, text, ordinal.  A comparison is a row id with parts: matter, row, doc,
quote, anchor, a row a part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import days_in
from tessera.functions.rows import is_table_row, quoted, row
from tessera.functions.text import collapsed, content_words, money_value
from tessera.functions.words import folded_words, negated, shared_run, title_of, verbs
from tessera.operators import dossier, links
from tessera.operators.report import shared_names, unique_title_words, warranties

# The parts of a matter in order, what stands for nothing, and what joins the parts of a comparison.
SECTIONS = ("Documents", "Timeline", "Names", "Figures", "Models blind to it", "Comparisons", "Lesser matters")
EMPTY, JOIN, UNDATED = "-", " || ", "9999-99-99"
# Words of a window of days, of a ticket, and of opening one.
WINDOW_WORDS, TICKET_WORDS, OPENING_WORDS = r"(?i)\bwithin\b", r"(?i)\bticket\b", r"(?i)\b(open|opened|opens)\b"


@dataclass
class Notes:
    """flags: doc, seq, flag, quote, anchor.  figures: doc, seq, surface, quote, anchor.  references: doc, seq, kind, value, quote, anchor.  concealed: doc, seq, quote, anchor."""

    flags: DataFrame
    figures: DataFrame
    references: DataFrame
    concealed: DataFrame

    def docs(self) -> DataFrame:
        """Documents with a note that says something: doc."""
        return self.flags.select("doc").unionByName(self.figures.select("doc")).unionByName(self.references.select("doc")).unionByName(self.concealed.select("doc")).distinct()


def worried_about(clusters: DataFrame, nodes: DataFrame, flags: DataFrame) -> DataFrame:
    """Documents of a cluster that another one's flags name by a word of their title alone: matter, doc.

    Flags that quote a row of a table name nobody.
    """
    unique = unique_title_words(nodes.select("doc", content_words(title_of(F.col("path"))).alias("words"))).join(clusters, "doc")
    said = flags.where(~is_table_row(F.col("quote"))).select(F.col("doc").alias("by"), F.explode(content_words(F.concat_ws(" ", "flag", "quote"))).alias("word")).distinct()
    said = said.join(clusters.select("matter", F.col("doc").alias("by")), "by")
    return unique.join(said, ["matter", "word"]).where("doc <> by").select("matter", "doc").distinct()


def matter_sets(clusters: DataFrame, seeds: DataFrame, nodes: DataFrame, notes: Notes) -> DataFrame:
    """The clusters without the documents that deny the matter: matter, doc.

    A document denies it if one of its flags negates a verb that a flag of another document of the
    cluster uses without negation, and both write a telling run of words.  Seeds stay, and so do
    documents that others worry about by name; a matter whose seeds have no note keeps all.
    """
    words = folded_words(F.col("quote"))
    own = notes.flags.join(clusters, "doc").select("matter", "doc", "seq", words.alias("words")).withColumn("verb", F.explode(verbs(F.col("words"))))
    negates = negated(F.col("words"), F.col("verb"))
    against = own.where(negates)
    plain = own.where(~negates).select("matter", "verb", F.col("doc").alias("other"), F.col("words").alias("said"))
    met = against.join(plain, ["matter", "verb"]).where("doc <> other").where(shared_run(F.col("words"), F.col("said")).isNotNull())
    denying = met.select("matter", "doc").distinct()
    denying = denying.join(seeds.select("matter", "doc"), ["matter", "doc"], "left_anti").join(worried_about(clusters, nodes, notes.flags), ["matter", "doc"], "left_anti")
    told = seeds.join(notes.docs(), "doc", "left_semi").select("matter").distinct()
    return clusters.select("matter", "doc").join(denying.join(told, "matter", "left_semi"), ["matter", "doc"], "left_anti")


def _closest(asks: DataFrame, sections: DataFrame) -> DataFrame:
    """The section of a document (doc, anchor, text) that shares most words with an ask (ask, doc, words, without): ask, doc, anchor, text.

    Words meet words of the same document; of equals the earliest anchor.
    """
    wanted = asks.select("ask", "doc", F.explode(F.array_except("words", "without")).alias("w"))
    held = sections.join(asks.select("doc").distinct(), "doc", "left_semi").select("doc", "anchor", F.explode(content_words(F.col("text"))).alias("w"))
    shared = wanted.join(held, ["doc", "w"]).groupBy("ask", "doc", "anchor").agg(F.count("*").alias("n"))
    best = shared.groupBy("ask", "doc").agg(F.min(F.struct((-F.col("n")).alias("less"), "anchor")).alias("x")).select("ask", "doc", F.col("x.anchor").alias("anchor"))
    texts = sections.groupBy("doc", "anchor").agg(F.min_by("text", "ordinal").alias("text"))
    return best.join(texts, ["doc", "anchor"])


def compare_rows(sets: DataFrame, nodes: DataFrame, references: DataFrame, sections: DataFrame) -> DataFrame:
    """Asked against answered, as parts: matter, row, doc, quote, anchor.

    A document of the set names another one of it in a section that asks for a comparison.  The
    section of the other that shares most words with it answers, and the section of the first
    that shares most with the answer answers back.  Words of both documents' names do not count.
    """
    names = links.named_by(nodes).withColumnRenamed("doc", "other")
    said = references.withColumn("name", F.upper(F.trim("value"))).join(names, "name").where("other <> doc").select("doc", "other", "anchor").distinct()
    asked = said.join(sets, "doc").join(sets.withColumnRenamed("doc", "other"), ["matter", "other"])
    texts = sections.groupBy("doc", "anchor").agg(F.min_by("text", "ordinal").alias("text")).where(F.col("text").rlike(links.COMPARE_WORDS))
    paths = nodes.select("doc", "path")
    asked = asked.join(texts, ["doc", "anchor"]).join(paths, "doc").join(paths.select(F.col("doc").alias("other"), F.col("path").alias("other_path")), "other")
    ask = F.concat_ws("\u0001", "doc", "anchor", "other")
    asked = asked.select("matter", "doc", "other", "anchor", "text", ask.alias("ask"), content_words(F.concat_ws(" ", "doc", "path", "other", "other_path")).alias("without"))
    each = asked.select("ask", "doc", "other", "text", "without").distinct()
    answer = _closest(each.select("ask", F.col("other").alias("doc"), content_words(F.col("text")).alias("words"), "without"), sections)
    reply = answer.select("ask", content_words(F.col("text")).alias("words")).join(each.select("ask", "doc", "without"), "ask")
    back = _closest(reply, sections)
    part = lambda rows: rows.select("ask", "doc", "text", "anchor")
    first = each.join(answer.select("ask"), "ask", "left_semi").select("ask", "doc", "text").join(asked.select("ask", "anchor").distinct(), "ask")
    parts = part(first).unionByName(part(answer)).unionByName(part(back))
    row_id = F.concat_ws("\u0001", F.lit("compare"), "ask")
    return asked.select("matter", "ask").distinct().join(parts, "ask").select("matter", row_id.alias("row"), "doc", quoted(F.col("text")).alias("quote"), "anchor").distinct()


def model_rows(sets: DataFrame, consequences: DataFrame, notes: Notes) -> DataFrame:
    """A figure that a model still assumes against the series that turned, as parts.

    The model's side is the figure and the flags that share a word with it; the series' side the
    flags that name the day of the turn and the lowest reading with a day.
    """
    own = consequences.join(sets, ["matter", "doc"], "left_semi")
    number = links.figure_number(F.col("surface"))
    figures = notes.figures.withColumn("number", number).where("number is not null")
    models = own.where("kind = 'model-after'").select("matter", F.col("doc").alias("model"), "figure", "anchor")
    cited = models.join(figures.select(F.col("doc").alias("model"), F.col("number").alias("figure"), "anchor", "seq", "quote"), ["model", "figure", "anchor"])
    cited = cited.groupBy("matter", "model", "figure").agg(F.min(F.struct("seq", "anchor", "quote")).alias("x"))
    breaks = own.where("kind = 'series-break'").select("matter", F.col("doc").alias("broken"), "period").distinct()
    met = cited.join(breaks, "matter").join(figures.select(F.col("doc").alias("broken"), F.col("number").alias("figure")).distinct(), ["broken", "figure"])
    met = met.withColumn("row", F.concat_ws("\u0001", F.lit("model"), "model", "figure", "broken", "period"))
    turned = met.select("matter", "row", "period", F.col("broken").alias("doc")).join(notes.flags.select("doc", "quote", "anchor"), "doc").where(F.array_contains(days_in(F.col("quote")), F.col("period")))
    dated = figures.where(F.size(days_in(F.col("quote"))) > 0).groupBy("doc").agg(F.min(F.struct(F.col("number").cast("double").alias("reading"), "anchor", "quote")).alias("low"))
    lowest = met.select("matter", "row", F.col("broken").alias("doc")).join(dated, "doc").select("matter", "row", "doc", F.col("low.quote").alias("quote"), F.col("low.anchor").alias("anchor"))
    whole = turned.select("row").distinct().join(lowest.select("row").distinct(), "row")
    head = met.select("matter", "row", F.col("model").alias("doc"), F.col("x.quote").alias("quote"), F.col("x.anchor").alias("anchor"))
    beside = head.select("matter", "row", "doc", F.col("quote").alias("cited")).join(notes.flags.select("doc", "quote", "anchor"), "doc").where(F.arrays_overlap(content_words(F.col("quote")), content_words(F.col("cited"))))
    columns = ["matter", "row", "doc", "quote", "anchor"]
    every = head.select(columns).unionByName(beside.select(columns)).unionByName(turned.select(columns)).unionByName(lowest.select(columns))
    return every.join(whole, "row", "left_semi").select("matter", "row", "doc", quoted(F.col("quote")).alias("quote"), "anchor").distinct()


def deadline_rows(sets: DataFrame, notes: Notes, sections: DataFrame) -> DataFrame:
    """A window of days, the day it counts from, and the act of another document, as parts.

    A window is a figure in days beside `within`.  A document acts where its note names a day
    beside the same window, and only states it where it does not.  The row has the window, the
    earliest place of the set where a ticket is opened on a day, the acting document's first
    section that shares a word with the window, and its earliest section with a day.
    """
    days = F.regexp_extract("surface", r"(?i)([0-9]+)[\s-]?days?\b", 1)
    held = notes.figures.join(sets, "doc").withColumn("n", days).where((F.col("n") != "") & F.col("quote").rlike(WINDOW_WORDS)).select("matter", "doc", "n", collapsed(F.col("quote")).alias("quote"), "anchor")
    written = notes.flags.select("doc", "quote").unionByName(notes.figures.select("doc", "quote")).unionByName(notes.concealed.select("doc", "quote")).where(F.size(days_in(F.col("quote"))) > 0)
    counts = F.array_distinct(F.regexp_extract_all("quote", F.lit(r"(?i)\b([0-9]+)[\s-]?days?\b"), 1))
    dated = written.select("doc", F.explode(counts).alias("n")).distinct().withColumn("dated", F.lit(True))
    held = held.join(dated, ["doc", "n"], "left")
    stated, acted = held.where("dated is null"), held.where("dated").select("matter", "n", F.col("doc").alias("other")).distinct()
    met = stated.join(acted, ["matter", "n"]).where("doc <> other").withColumn("row", F.concat_ws("\u0001", F.lit("deadline"), "n", "doc", "anchor", "other"))
    own = sections.withColumn("day", F.array_min(days_in(F.col("text"))))
    tickets = own.where(F.col("text").rlike(TICKET_WORDS) & F.col("text").rlike(OPENING_WORDS) & F.col("day").isNotNull()).join(sets, "doc")
    opened = tickets.groupBy("matter").agg(F.min(F.struct("day", "anchor", "doc", "text")).alias("x")).select("matter", F.col("x.doc").alias("doc"), F.col("x.text").alias("quote"), F.col("x.anchor").alias("anchor"))
    wanted = met.select("row", F.col("other").alias("doc"), F.explode(content_words(F.col("quote"))).alias("w"))
    said = sections.join(met.select(F.col("other").alias("doc")).distinct(), "doc", "left_semi").select("doc", "ordinal", "anchor", F.explode(content_words(F.col("text"))).alias("w"))
    first = wanted.join(said, ["doc", "w"]).groupBy("row", "doc").agg(F.min(F.struct("ordinal", "anchor")).alias("x")).select("row", "doc", F.col("x.anchor").alias("anchor"))
    earliest = own.where("day is not null").groupBy("doc").agg(F.min(F.struct("day", "anchor")).alias("x")).select("doc", F.col("x.anchor").alias("anchor"))
    texts = sections.groupBy("doc", "anchor").agg(F.min_by("text", "ordinal").alias("quote"))
    acts = first.unionByName(first.select("row", "doc").join(earliest, "doc")).distinct().join(texts, ["doc", "anchor"])
    rows = met.join(first.select("row"), "row", "left_semi")
    columns = ["matter", "row", "doc", "quote", "anchor"]
    every = rows.select(columns).unionByName(rows.select("matter", "row").join(opened, "matter").select(columns)).unionByName(rows.select("matter", "row").join(acts, "row").select(columns))
    return every.select("matter", "row", "doc", quoted(F.col("quote")).alias("quote"), "anchor").distinct()


def _sides(rows: DataFrame, rule: str, *sides: tuple[str, str, str]) -> DataFrame:
    """Rows of two sides, each a document, quote and anchor column, as parts."""
    row_id = F.concat_ws("\u0001", F.lit(rule), *(F.col(c).cast("string") for side in sides for c in side))
    parts = F.array(*(F.struct(F.col(d).alias("doc"), quoted(F.col(q)).alias("quote"), F.col(a).alias("anchor")) for d, q, a in sides))
    return rows.select("matter", row_id.alias("row"), F.explode(parts).alias("p")).select("matter", "row", "p.*")


def comparisons(sets: DataFrame, seeds: DataFrame, versions: DataFrame, consequences: DataFrame, nodes: DataFrame, notes: Notes, sections: DataFrame) -> DataFrame:
    """The parts of all comparisons that the eight rules find."""
    flags, figures = notes.flags.join(sets, "doc"), notes.figures.join(sets, "doc")
    pairs = dossier.version_rows(versions.select("matter", "draft", "final"), flags)
    found = [
        _sides(pairs, "version", ("draft", "a_quote", "a_anchor"), ("final", "b_quote", "b_anchor")),
        _sides(dossier.reserve_rows(figures), "reserve", ("reserve_doc", "reserve_quote", "reserve_anchor"), ("estimate_doc", "estimate_quote", "estimate_anchor")),
        deadline_rows(sets, notes, sections),
        model_rows(sets, consequences, notes),
        _sides(dossier.covenant_rows(flags, seeds), "covenant", ("clause_doc", "clause_quote", "clause_anchor"), ("seed_doc", "seed_quote", "seed_anchor")),
        _sides(dossier.policy_rows(flags, figures), "policy", ("limit_doc", "limit_quote", "limit_anchor"), ("practice_doc", "practice_quote", "practice_anchor")),
        _sides(warranties(flags), "warranty", ("said_doc", "said_quote", "said_anchor"), ("open_doc", "open_quote", "open_anchor")),
        compare_rows(sets, nodes, notes.references, sections),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def comparison_lines(parts: DataFrame) -> DataFrame:
    """Comparisons as lines in order: matter, place, line.  Rows that name the same documents are one.

    A matter's documents name its comparisons, so what one line gathers is bounded by a matter.
    """
    named = parts.groupBy("matter", "row").agg(F.sort_array(F.collect_set("doc")).alias("docs"))
    merged = parts.join(named, ["matter", "row"]).groupBy("matter", "docs").agg(F.sort_array(F.collect_set(F.struct("doc", "anchor", "quote"))).alias("parts"))
    said = F.transform("parts", lambda p: F.concat_ws(" | ", p["doc"], F.when(p["quote"] == "", EMPTY).otherwise(p["quote"]), p["anchor"]))
    lines = merged.select("matter", F.col("parts.doc").alias("order"), F.concat(F.lit("- "), F.array_join(said, JOIN)).alias("line"))
    return lines.select("matter", F.row_number().over(Window.partitionBy("matter").orderBy("order", "line")).alias("place"), "line")


def _placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    return rows.select("matter", F.row_number().over(Window.partitionBy("matter").orderBy(*order)).alias("place"), "line")


def documents_lines(sets: DataFrame, ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents of the set in the order of the map."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) == "", EMPTY).otherwise(c)
    own = ranked.join(sets, ["matter", "doc"], "left_semi").join(nodes, "doc")
    line = F.concat(F.lit("- "), F.col("place").cast("string"), F.lit(". "), F.concat_ws(" | ", "doc", title_of(F.col("path")), some(F.col("folder")), some(F.col("date")), some(F.array_join("status", ", "))))
    return _placed(own.select("matter", F.col("place").alias("rank"), line.alias("line")), "rank")


def timeline_lines(sets: DataFrame, nodes: DataFrame, notes: Notes, dated: DataFrame, sections: DataFrame) -> DataFrame:
    """Dated statements, figures whose quote names a day, and dated sections (doc, day, anchor), by day."""
    first = F.get(days_in(F.col("quote")), F.lit(0))
    said = notes.flags.select("doc", "quote", "anchor").unionByName(notes.concealed.select("doc", "quote", "anchor")).join(nodes.select("doc", "date"), "doc", "left")
    rows = said.select(F.coalesce(first, "date", F.lit(UNDATED)).alias("day"), "doc", "quote", "anchor")
    rows = rows.unionByName(notes.figures.select(first.alias("day"), "doc", "quote", "anchor").where("day is not null"))
    texts = sections.groupBy("anchor").agg(F.min_by("text", "ordinal").alias("quote"))
    rows = rows.unionByName(dated.join(texts, "anchor", "left").select("day", "doc", F.coalesce("quote", F.lit("")).alias("quote"), "anchor"))
    own = rows.withColumn("quote", collapsed(F.col("quote"))).distinct().join(sets, "doc")
    day = F.when(F.col("day") != UNDATED, F.col("day"))
    return _placed(own.withColumn("line", row(F.coalesce(day, F.lit("")), F.col("doc"), F.col("quote"), F.col("anchor"))), "day", "doc", "quote", "anchor")


def names_lines(sets: DataFrame, references: DataFrame) -> DataFrame:
    """Codes, names and tickets that two documents of a matter's set share."""
    own = references.join(sets, "doc").withColumn("key", F.concat_ws("\u0001", F.col("matter").cast("string"), "value"))
    found = shared_names(own.select("doc", "seq", "kind", F.col("key").alias("value"), "quote", "anchor"), sets.select("doc").distinct())
    found = found.select(F.split("value", "\u0001").alias("k"), "doc", "quote", "anchor").select(F.get("k", F.lit(0)).alias("matter"), F.get("k", F.lit(1)).alias("value"), "doc", "quote", "anchor")
    found = found.join(sets.select("matter", "doc").withColumn("matter", F.col("matter").cast("string")), ["matter", "doc"], "left_semi").withColumn("matter", F.col("matter").cast(sets.schema["matter"].dataType))
    return _placed(found.withColumn("line", row(F.col("value"), F.col("doc"), F.col("quote"), F.col("anchor"))), "value", "doc")


def figures_lines(sets: DataFrame, figures: DataFrame) -> DataFrame:
    own = figures.join(sets, "doc")
    return _placed(own.withColumn("line", row(F.col("surface"), F.col("doc"), F.col("quote"), F.col("anchor"))), "doc", "anchor", "surface", collapsed(F.col("quote")))


def blind_lines(sets: DataFrame, consequences: DataFrame) -> DataFrame:
    """Series that turned and models that kept a figure."""
    what = F.concat_ws(" ", "kind", F.when(F.col("kind") == "series-break", F.col("series")).otherwise(F.col("figure")))
    own = consequences.join(sets, ["matter", "doc"], "left_semi").withColumn("what", what)
    return _placed(own.withColumn("line", row(F.col("period"), F.col("doc"), F.col("what"), F.col("anchor"))), F.desc("kind"), "doc", "period", "what")


def lesser_lines(sets: DataFrame, notes: Notes) -> DataFrame:
    """Flagged documents outside a matter's set by their largest money, each with its first flag."""
    largest = notes.figures.withColumn("money", money_value(F.trim("surface"))).where("money > 0").groupBy("doc").agg(F.max("money").alias("money"), F.max_by("surface", F.struct("money", -F.col("seq"))).alias("surface"))
    first = notes.flags.groupBy("doc").agg(F.min(F.struct("seq", "quote", "anchor")).alias("x")).join(largest, "doc", "left")
    matters = sets.select("matter").distinct()
    # One to three matters beside every flagged document.
    outside = first.join(F.broadcast(matters.limit(1000))).join(sets, ["matter", "doc"], "left_anti")
    line = row(F.coalesce("surface", F.lit("")), F.col("doc"), F.col("x.quote"), F.col("x.anchor"))
    return _placed(outside.withColumn("line", line), F.desc(F.coalesce("money", F.lit(0.0))), "doc")


def dossier_lines(clusters: DataFrame, seeds: DataFrame, ranked: DataFrame, consequences: DataFrame, versions: DataFrame, nodes: DataFrame, notes: Notes, dated: DataFrame, sections: DataFrame) -> DataFrame:
    """All lines of the dossiers: matter, section, place, line."""
    sets = links.written(matter_sets(clusters, seeds, nodes, notes), "sets")
    found = [
        documents_lines(sets, ranked, nodes),
        timeline_lines(sets, nodes, notes, dated, sections),
        names_lines(sets, notes.references),
        figures_lines(sets, notes.figures),
        blind_lines(sets, consequences),
        comparison_lines(comparisons(sets, seeds, versions, consequences, nodes, notes, sections)),
        lesser_lines(sets, notes),
    ]
    out = None
    for name, lines in zip(SECTIONS, found, strict=True):
        own = lines.select("matter", F.lit(name).alias("section"), "place", "line")
        out = own if out is None else out.unionByName(own)
    return out


def markdown(lines: DataFrame, matters: DataFrame) -> DataFrame:
    """One text for each matter (matter, seed, date): matter, text.  Sections without lines keep their heading."""
    order = F.create_map(*(F.lit(x) for k, name in enumerate(SECTIONS) for x in (name, k)))
    own = lines.groupBy("matter", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))
    every = matters.select("matter", F.explode(F.array(*(F.lit(s) for s in SECTIONS))).alias("section")).join(own, ["matter", "section"], "left")
    block = F.concat(F.lit("### "), F.col("section"), F.lit("\n"), F.when(F.col("text").isNotNull(), F.concat(F.lit("\n"), "text", F.lit("\n"))).otherwise(""))
    bodies = every.select("matter", order[F.col("section")].alias("k"), block.alias("block")).groupBy("matter").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "block"))), lambda x: x["block"]), "\n").alias("body"))
    head = F.concat(F.lit("## Matter "), F.col("matter").cast("string"), F.lit("\n\nSeed "), F.col("seed"), F.lit(". Date "), F.coalesce("date", F.lit(EMPTY)), F.lit(".\n\n"))
    return matters.join(bodies, "matter").select("matter", F.concat(head, "body").alias("text"))
