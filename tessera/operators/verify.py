"""Checks of cited statements against what they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import carry
from tessera.functions.anchors import document_of
from tessera.functions.rows import strip_citations
from tessera.functions.text import collapsed
from tessera.operators import contained
from tessera.operators.ranking import if_small

# Certainty words, weakest rung first.
RUNGS = (
    ("may", "might", "could", "possible", "potential"),
    ("likely", "probable", "indicative", "expected", "approximately", "estimated"),
    ("confirmed", "certain", "conclusive", "definitive", "established"),
)
#: Characters by which parts of words are looked up.
GRAM = 3


def located(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that hold a quote verbatim: quote, doc, at (character, from 1).

    quotes: quote, text.  docs: doc, text.  A quote's longest word chooses the
    documents to look into, so that quotes meet only texts with that word.  The
    first and last word of a quote may be parts of words: a quote without a word
    between them is looked for in the different words (and runs of white space)
    of all documents, by its first characters, and then where those stand.
    Empty quotes and quotes of spaces only are left out.
    """
    words = F.regexp_extract_all("text", F.lit(r"\S+"), 0)
    longest = lambda a: F.array_max(F.transform(a, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    wanted = quotes.where(F.trim("text") != "").select(F.col("text").alias("sought"), words.alias("words")).distinct()
    inside = F.size("words") >= 3
    held = docs.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\S+|\s+"), 0))).alias("w"))
    near = wanted.where(inside).select("sought", longest(F.slice("words", 2, F.size("words") - 2)).alias("w"))
    short = wanted.where(~inside).select("sought", F.coalesce(longest(F.col("words")), F.col("sought")).alias("part"))
    if not short.isEmpty():
        starts = lambda k: F.sequence(F.lit(1), F.greatest(F.length("w") - (k - 1), F.lit(1)))
        grams = F.array_distinct(F.concat(*(F.transform(starts(k), lambda at: F.substr("w", at, F.lit(k))) for k in range(1, GRAM + 1))))
        parts = held.select("w").distinct().select("w", F.explode(grams).alias("gram"))
        hit = short.withColumn("gram", F.left("part", F.lit(GRAM))).join(parts, "gram").where(F.contains("w", "part"))
        near = near.unionByName(hit.select("sought", "w"))
    found = held.join(if_small(near), "w").select("sought", "doc").distinct().join(docs, "doc").withColumn("at", F.expr("instr(text, sought)")).where("at > 0")
    return quotes.join(found.select("sought", "doc", "at"), quotes["text"] == F.col("sought")).select("quote", "doc", F.col("at").cast("long").alias("at"))


def failed_citations(cited: DataFrame, anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """Citations `doc#l<line>` that do not parse, or name no document or no line: id, citation, reason."""
    parsed = cited.withColumn("doc", F.regexp_extract("citation", "^(.+)#l[0-9]+$", 1)).withColumn("parses", F.col("doc") != "")
    no_doc = parsed.where("parses").join(docs.select(F.col("doc").cast("string").alias("doc")).distinct(), "doc", "left_anti").select("id", "citation", F.lit("no such document").alias("reason"))
    here = parsed.where("parses").join(docs.select(F.col("doc").cast("string").alias("doc")).distinct(), "doc", "left_semi")
    no_line = here.join(anchors.select(F.col("anchor").alias("citation")).distinct(), "citation", "left_anti").select("id", "citation", F.lit("no such line").alias("reason"))
    return parsed.where("not parses").select("id", "citation", F.lit("no citation").alias("reason")).unionByName(no_doc).unionByName(no_line)


def unsupported_numbers(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Numbers of claims (id, doc, text) that their document (doc, text) does not write: id, number."""
    numbers = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit("[0-9][0-9,]*(?:[.][0-9]+)?"), 0), lambda x: F.replace(x, F.lit(","), F.lit(""))))
    # A document's numbers are put together first, so that claims meet one row of each.
    held = evidence.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_set(numbers(F.col("text"))))).alias("held"))
    said = claims.select("id", "doc", numbers(F.col("text")).alias("said")).where(F.size("said") > 0).join(held, "doc", "left")
    return said.select("id", F.explode(F.array_except("said", F.coalesce("held", F.array().cast("array<string>")))).alias("number"))


def unsourced_numbers(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """Numbers and days of sentences (id, text, anchor; a row a citation) that no section or row they cite (anchor, text) has: id, number."""
    held = sources.groupBy("anchor").agg(F.collect_set("text").alias("texts")).select("anchor", F.array_union(F.flatten(F.transform("texts", carry.source_numbers)), F.flatten(F.transform("texts", carry.days_of))).alias("held"))
    own = cited.join(held, "anchor", "left").groupBy("id").agg(F.max("text").alias("text"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("held", F.array().cast("array<string>"))))).alias("held"))
    said = F.array_union(carry.sentence_numbers(F.col("text")), carry.days_of(strip_citations(F.col("text"))))
    return own.select("id", F.explode(F.array_except(said, "held")).alias("number"))


def rung(text: F.Column) -> F.Column:
    """The strongest rung of certainty that a text's words reach; 0 if none."""
    out = F.lit(0)
    for k, words in enumerate(RUNGS, 1):
        out = F.when(F.lower(text).rlike(rf"\b({'|'.join(words)})\b"), F.lit(k)).otherwise(out)
    return out


def highest_word(text: F.Column) -> F.Column:
    """The first word of the strongest rung that a text reaches; empty if none."""
    out = F.lit("")
    for words in RUNGS:
        found = F.regexp_extract(F.lower(text), rf"\b({'|'.join(words)})\b", 1)
        out = F.when(found != "", found).otherwise(out)
    return out


def too_certain(cited: DataFrame, sections: DataFrame) -> DataFrame:
    """Sentences (id, text, anchor; a row for each citation) on a higher rung than any section
    (anchor, text) they cite: id, rung, held, word.  Sections that are not there hold nothing.
    """
    held = cited.join(sections.select("anchor", rung(F.col("text")).alias("r")), "anchor", "left").groupBy("id").agg(F.max("text").alias("text"), F.coalesce(F.max("r"), F.lit(0)).alias("held"))
    return held.select("id", rung(F.col("text")).alias("rung"), "held", highest_word(F.col("text")).alias("word")).where("rung > held")


def failures_by_check(failures: DataFrame, checks: list[str]) -> DataFrame:
    """How many failures (check) each check has, those without any too: check, n."""
    names = failures.sparkSession.createDataFrame([(c,) for c in checks], "check string")
    return names.join(failures.groupBy("check").agg(F.count("*").alias("m")), "check", "left").select("check", F.coalesce("m", F.lit(0)).alias("n"))


def recalled(facts: DataFrame, reports: DataFrame) -> DataFrame:
    """Facts (report, fact, kind, value, documents) that their report (report, text) carries: report, fact, hit.

    A document fact needs all its documents named; a comparison one of them and both sides
    (around ` against `) carried; any other one of them and its value in the report.  A fact
    without a report is not carried.
    """
    texts = lambda c: reports.select(F.col("report").alias("room"), c.alias("text"))
    # Names and values are looked up in their reports together; each fact then meets its own marks.
    lists = facts.where("documents is not null").select("report", "documents").distinct().join(reports.select("report").distinct(), "report")
    names = lists.select("report", "documents", F.explode_outer(F.transform("documents", F.lower)).alias("name"))
    seen = contained.held(names.select(F.col("report").alias("room"), F.col("name").alias("quote")), texts(F.lower("text")))
    marked = names.join(seen.select(F.col("room").alias("report"), F.col("quote").alias("name"), F.lit(True).alias("seen")), ["report", "name"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    named = marked.groupBy("report", "documents").agg(F.some("seen").alias("one"), F.every(F.col("seen") | (F.size("documents") == 0)).alias("all"))
    asked = facts.withColumn("sought", carry.normalised(F.col("value")))
    values = asked.where("kind is null or kind not in ('document', 'comparison')").select(F.col("report").alias("room"), F.col("sought").alias("quote"))
    held = contained.held(values, texts(carry.normalised(F.col("text")))).select(F.col("room").alias("report"), F.col("quote").alias("sought"), F.lit(True).alias("written"))
    own = reports.select("report", carry.numbers_of(F.col("text")).alias("numbers"), carry.days_of(F.col("text")).alias("days"), carry.words_of(F.col("text")).alias("words"))
    sides = F.forall(F.split("value", " against "), lambda s: carry.side_carried(s, F.col("numbers"), F.col("days"), F.col("words")))
    compared = facts.where("kind = 'comparison'").select("report", "value").distinct().join(own, "report").select("report", "value", sides.alias("sides"))
    both = asked.join(named, ["report", "documents"], "left").join(held, ["report", "sought"], "left").join(compared, ["report", "value"], "left")
    hit = F.when(F.col("kind") == "document", F.col("all")).when(F.col("kind") == "comparison", F.col("one") & F.col("sides")).otherwise(F.col("one") & F.col("written"))
    return both.select("report", "fact", F.coalesce(hit, F.lit(False)).alias("hit"))


def recall(facts: DataFrame, found: DataFrame) -> DataFrame:
    """Share of facts (fact) that were found (fact), in percent, and how many: n, n_found, recall."""
    marked = facts.select("fact").distinct().join(found.select("fact").distinct().withColumn("hit", F.lit(1)), "fact", "left")
    return marked.agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"), F.round(100 * F.avg(F.coalesce("hit", F.lit(0))), 2).alias("recall"))


def uncarried(findings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Findings (id, anchor, finding) that the paragraphs (text) with their anchor, taken together,
    do not carry: all figures and half of the words.  id, anchor, finding.

    Paragraphs meet findings by the documents of the anchors they write.  Of a paragraph only the
    finding's own words and figures go on, so what is gathered for a finding is bounded by it.
    """
    bare = lambda a: F.transform(a, lambda f: F.replace(f, F.lit(","), F.lit("")))
    wanted = findings.select("id", "anchor", "finding", carry.finding_words(F.col("finding")).alias("words"), bare(carry.figures_of(F.col("finding"))).alias("figures")).withColumn("doc", document_of(F.col("anchor")))
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\s\[\]|]+#[^\s\[\]|]+"), 0))
    said = paragraphs.where(F.trim("text") != "").select("text", F.explode(tokens).alias("token")).withColumn("doc", document_of(F.col("token")))
    # A token may close with signs, but the anchor of line 7 is not that of line 78.
    met = wanted.join(said, "doc").where(F.contains("token", "anchor") & ~F.substr("token", F.instr("token", F.col("anchor")) + F.length("anchor"), F.lit(1)).rlike("[A-Za-z0-9]"))
    own = met.select("id", F.array_intersect("words", F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z\-]{3,}"), 0)).alias("w"), F.array_intersect("figures", bare(carry.figures_written(F.col("text")))).alias("f"))
    held = own.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("w"))).alias("w"), F.array_distinct(F.flatten(F.collect_set("f"))).alias("f"))
    carried = (F.size(F.array_except("figures", "f")) == 0) & (F.size("w") * 2 >= F.size("words"))
    return wanted.join(held, "id", "left").where(~F.coalesce(carried, F.lit(False))).select("id", "anchor", "finding")


def kept_findings(findings: DataFrame, quotes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (id, doc, quote) whose quote is in a quote (doc, seq, quote, anchor) of their document.

    docs (doc) is the group that was asked about.  Returns (id, doc, quote, anchor) and (id, reason).
    """
    flat = lambda c: collapsed(F.col(c))
    inside = findings.join(docs, "doc", "left_semi")
    strange = findings.join(docs, "doc", "left_anti").select("id", F.lit("no such document in the group").alias("reason"))
    met = inside.withColumn("sought", flat("quote")).join(quotes.select("doc", "seq", flat("quote").alias("held"), "anchor"), "doc").where(F.contains("held", "sought") & (F.col("sought") != ""))
    kept = met.groupBy("id").agg(F.min_by("anchor", "seq").alias("anchor"))
    return inside.join(kept, "id").select("id", "doc", "quote", "anchor"), strange.unionByName(inside.join(kept, "id", "left_anti").select("id", F.lit("quote not found").alias("reason")))
