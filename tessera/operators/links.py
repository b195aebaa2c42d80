"""Links of a matter: what notes write down, and the rules that take documents into its set.

Notes are flat tables: flags (doc, seq, flag, quote, consequence, about, anchor), figures (doc, seq,
surface, quote, anchor), references (doc, seq, kind, value, quote, anchor) and concealed (doc, seq,
claim, quote, anchor).  All matters are worked out in one plan: `seeds` and `inside` have one row
(seed, doc) for each document of a matter's seed or set.  A rule returns seed, doc, from, kind, values.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_count
from tessera.functions.words import fold, folded_words, name_forms, shared_run, word_runs
from tessera.operators.graph import DATE_WINDOW, KIND_WEIGHTS

# Share of documents from which a value or a window is too common to reach a document,
# carriers up to which a money figure names a matter, values listed as reasons.
REACH_SHARE, MONEY_CARRIERS, WHY = 0.25, 6, 3
# How a matter stands beside the first one: share of documents, days apart.
MATTER_SHARE, MATTER_SPAN = 0.125, 730
# Words that ask for a comparison, and that end an agreement.
COMPARE_WORDS = r"(?i)\b(compare|compared|compares|comparison|reconcile|reconciled|reconciles|reconciliation|versus)\b"
TERMINATION_WORDS = r"(?i)\b(terminate|terminates|termination)\b"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows through the folder of spark.checkpoint.dir, so that lineage ends here; through one of
    this machine's only where the session names none, as in tests.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_tessera_folder", None)
    if not folder:
        folder = spark._tessera_folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def name_groups(references: DataFrame, rounds: int = 40) -> DataFrame:
    """Names that share forms, as groups: form, key (smallest form), spelling (smallest value).

    Labels travel between values and forms, and to the label's own label, until nothing changes.
    """
    values = references.where("kind in ('name', 'person')").select("value").distinct()
    forms = written(values.select("value", F.explode(name_forms(F.col("value"))).alias("form")), "forms")
    labels = forms.select("value", F.col("value").alias("label")).distinct()
    for _ in range(rounds):
        by_form = forms.join(labels, "value").groupBy("form").agg(F.min("label").alias("label"))
        near = forms.join(by_form, "form").groupBy("value").agg(F.min("label").alias("label"))
        onward = labels.select(F.col("value").alias("label"), F.col("label").alias("further"))
        new = written(near.join(onward, "label").select("value", F.least("label", "further").alias("label")), "labels")
        if new.join(labels.withColumnRenamed("label", "old"), "value").where("label <> old").isEmpty():
            break
        labels = new
    else:
        raise RuntimeError(f"names were still changing groups after {rounds} rounds")
    keys = forms.join(labels, "value").groupBy("label").agg(F.min("form").alias("key"), F.min("value").alias("spelling"))
    return forms.join(labels, "value").join(keys, "label").select("form", "key", "spelling").distinct()


def keyed(rows: DataFrame, groups: DataFrame, value: str = "value") -> DataFrame:
    """Rows with the key of the name group that their value belongs to, by its first form that has one."""
    found = rows.select(value).distinct().select(value, F.posexplode(name_forms(F.col(value))).alias("at", "form")).join(groups.select("form", "key"), "form").groupBy(value).agg(F.min_by("key", "at").alias("key"))
    return rows.join(found, value, "left")


def person_values(references: DataFrame, groups: DataFrame) -> DataFrame:
    """Names, by group, that are called a person as often as anything else: name."""
    named = keyed(references, groups).withColumn("name", F.coalesce("key", "value")).groupBy("name", "kind").agg(F.count("*").alias("n"))
    sums = named.groupBy("name").agg(F.max(F.when(F.col("kind") == "person", F.col("n"))).alias("people"), F.max(F.when(F.col("kind") != "person", F.col("n"))).alias("other"))
    return sums.where("people >= coalesce(other, 0)").select("name")


def written_values(references: DataFrame, figures: DataFrame) -> DataFrame:
    """Folded values that notes write, as references that are no persons or as figures: value."""
    both = references.where("kind <> 'person'").select(fold(F.col("value")).alias("value")).union(figures.select(fold(F.col("surface")).alias("value")))
    return both.where("value <> ''").distinct()


def runs_of(values: DataFrame, *carry: str) -> DataFrame:
    """All runs of words of folded values, with the columns to carry: run."""
    return values.where("value <> ''").select(*carry, F.explode(word_runs(F.col("value"))).alias("run")).distinct()


def figure_writers(figures: DataFrame) -> DataFrame:
    """Runs of words of figures with the documents that read them: run, doc."""
    return runs_of(figures.select("doc", fold(F.col("surface")).alias("value")), "doc")


def reference_runs(references: DataFrame) -> DataFrame:
    """Runs of words of references that are no persons: run."""
    return runs_of(references.where("kind <> 'person'").select(fold(F.col("value")).alias("value")))


def citations(references: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose notes write another document's id: citing, cited."""
    return references.select(F.col("doc").alias("citing"), F.upper(F.trim("value")).alias("cited")).join(docs.select(F.col("doc").alias("cited")), "cited", "left_semi").where("citing <> cited").select("citing", "cited").distinct()


def about(flags: DataFrame, concealed: DataFrame, groups: DataFrame) -> DataFrame:
    """What each document's notes are about: doc, values (folded, with keys of names), hidden (folded)."""
    named = keyed(flags.select("doc", F.explode("about").alias("value")), groups)
    values = named.select("doc", F.explode(F.array(fold(F.col("value")), "key")).alias("v")).where("v <> ''").groupBy("doc").agg(F.sort_array(F.collect_set("v")).alias("values"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "claim", "quote"))), lambda x: F.concat_ws(" ", x["claim"], x["quote"]))
    hidden = concealed.groupBy("doc").agg(fold(F.array_join(parts, " ")).alias("hidden"))
    return values.join(hidden, "doc", "full").select("doc", F.coalesce("values", F.array().cast("array<string>")).alias("values"), F.coalesce("hidden", F.lit("")).alias("hidden"))


def is_about(values: Column, hidden: Column, folded: Column) -> Column:
    """A note is about a folded value: as one of its values, within one if it has a digit, or hidden."""
    inside = F.exists(values, lambda v: F.concat(F.lit(" "), v, F.lit(" ")).contains(F.concat(F.lit(" "), folded, F.lit(" "))))
    return (folded != "") & (F.array_contains(values, folded) | folded.rlike("[0-9]") & inside | hidden.contains(folded))


def value_links(edges: DataFrame) -> DataFrame:
    """The values by which documents are linked, both ways: doc, other, value, weight, carriers.

    Days and bare counts link nothing; of one value shared in several ways the heaviest stands.
    """
    weights = F.create_map(*(F.lit(x) for kv in KIND_WEIGHTS.items() for x in kv))
    carriers = F.greatest(F.lit(2), F.bround(weights[F.col("kind")] / F.col("weight")).cast("int"))
    own = edges.where((F.col("kind") != "date") & ~is_count(F.col("value"))).withColumn("carriers", carriers)
    both = own.select(F.col("a").alias("doc"), F.col("b").alias("other"), "value", "weight", "carriers").unionByName(own.select(F.col("b").alias("doc"), F.col("a").alias("other"), "value", "weight", "carriers"))
    return both.groupBy("doc", "other", "value").agg(F.max("weight").alias("weight"), F.max_by("carriers", "weight").alias("carriers"))


def _link(rows: DataFrame, kind: str, heads: Column, values: Column) -> DataFrame:
    return rows.groupBy("seed", "doc").agg(F.sort_array(heads).alias("from"), F.lit(kind).alias("kind"), F.sort_array(values).alias("values"))


def _outside(rows: DataFrame, inside: DataFrame) -> DataFrame:
    return rows.join(inside.select("seed", "doc"), ["seed", "doc"], "left_anti")


def _heaviest(rows: DataFrame) -> DataFrame:
    """Rows (seed, doc, value, weight, head) of each document's heaviest values, one row a value."""
    each = rows.groupBy("seed", "doc", "value").agg(F.max("weight").alias("weight"), F.min_by("head", F.struct(-F.col("weight"), "head")).alias("head"))
    rank = F.row_number().over(Window.partitionBy("seed", "doc").orderBy(F.desc("weight"), "value"))
    return each.withColumn("r", rank).where(F.col("r") <= WHY).drop("r")


def shared_links(seeds: DataFrame, shared: DataFrame) -> DataFrame:
    """Documents that share a value with the seed, with the heaviest of these values."""
    met = _outside(shared.join(seeds.select("seed", F.col("doc").alias("other")), "other").withColumnRenamed("other", "head"), seeds)
    heads = met.groupBy("seed", "doc").agg(F.sort_array(F.collect_set("head")).alias("from"))
    return heads.join(_heaviest(met).groupBy("seed", "doc").agg(F.sort_array(F.collect_list("value")).alias("values")), ["seed", "doc"]).select("seed", "doc", "from", F.lit("shared").alias("kind"), "values")


def version_links(pairs: DataFrame, inside: DataFrame) -> DataFrame:
    """The other half of version pairs (draft, final) of which one half is in the set."""
    both = pairs.select(F.col("draft").alias("doc"), F.col("final").alias("head")).union(pairs.select(F.col("final").alias("doc"), F.col("draft").alias("head")))
    met = _outside(both.join(inside.select("seed", F.col("doc").alias("head")), "head"), inside)
    last = met.groupBy("seed", "doc").agg(F.max("head").alias("head"))
    return last.select("seed", "doc", F.array("head").alias("from"), F.lit("version").alias("kind"), F.sort_array(F.array("doc", "head")).alias("values"))


def break_links(broken: DataFrame, seeds: DataFrame) -> DataFrame:
    """Documents whose series (seed, doc, period) breaks, linked to the whole seed."""
    heads = seeds.groupBy("seed").agg(F.sort_array(F.collect_set("doc")).alias("from"))
    return broken.groupBy("seed", "doc").agg(F.max("period").alias("period")).join(heads, "seed").select("seed", "doc", "from", F.lit("consequence").alias("kind"), F.array("period").alias("values"))


def figure_number(surface: Column) -> Column:
    """The number of a figure without currency, commas and up to two unit letters, as `%g` writes it; else null."""
    number = F.regexp_extract(F.regexp_replace(F.lower(surface.cast("string")), r"[,$\s]", ""), r"^([0-9]+(?:\.[0-9]+)?)[a-z]{0,2}$", 1).try_cast("double")
    digits = F.floor(F.log10(F.greatest(number, F.lit(1e-4))))
    plain = F.round(number * F.pow(F.lit(10.0), 5 - digits)) / F.pow(F.lit(10.0), 5 - digits)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", plain), r"0+$", ""), r"\.$", "")
    return F.when(number == 0, "0").when(number < 1e6, text).when(number >= 1e6, F.regexp_replace(F.regexp_replace(F.format_string("%.5e", number), r"\.?0+e", "e"), r"e\+?0*([0-9])$", "e+0$1"))


def model_links(modelled: DataFrame, figures: DataFrame, inside: DataFrame) -> DataFrame:
    """Models (seed, doc, figure) linked to the documents of the set that hold the same number."""
    held = figures.select(F.col("doc").alias("head"), figure_number(F.col("surface")).alias("figure")).where("figure is not null").distinct().join(inside.select("seed", F.col("doc").alias("head")), "head")
    return _link(modelled.join(held, ["seed", "figure"]).where("head <> doc"), "consequence", F.collect_set("head"), F.collect_set("figure"))


def reach_links(shared: DataFrame, inside: DataFrame, n_docs: int, runs: DataFrame, naming: DataFrame, readers: DataFrame, referenced: DataFrame) -> DataFrame:
    """Documents that the set reaches by two values of the matter, or by one money figure it owns.

    runs (run) are what notes write; naming (value, doc) who names a value, where anybody does;
    readers (run, doc) and referenced (run) tell a figure that only the judged document reads.
    A value is owned if everybody who names it (or, if nobody does, who holds it) is in the set
    or is the judged document.  The money route is read once more with what the first pass let in.
    """
    folded = fold(F.col("value"))
    read = readers.groupBy("run").agg(F.countDistinct("doc").alias("n_readers"), F.min("doc").alias("reader"))
    held = _outside(shared.where(F.col("carriers") <= REACH_SHARE * n_docs).join(inside.select("seed", F.col("doc").alias("other")), "other"), inside).withColumn("run", folded)
    held = held.join(runs.select("run").distinct(), "run", "left_semi").join(read, "run", "left").join(referenced.select("run").distinct().withColumn("named", F.lit(True)), "run", "left")
    held = held.where("named or n_readers > 1 or n_readers = 1 and reader <> doc").withColumn("money", F.col("value").startswith("$"))
    held = held.withColumn("witness", F.max(F.col("money") & (F.col("carriers") <= MONEY_CARRIERS)).over(Window.partitionBy("seed", "doc")))
    holders = shared.select("value", "doc").distinct()
    owners = naming.select("value", "doc").distinct().unionByName(holders.join(naming.select("value").distinct(), "value", "left_anti")).withColumnRenamed("doc", "owner")

    def judged(rows: DataFrame, settled: DataFrame) -> DataFrame:
        apart = rows.select("seed", "value").distinct().join(owners, "value").join(settled.select("seed", F.col("doc").alias("owner")), ["seed", "owner"], "left_anti")
        apart = apart.groupBy("seed", "value").agg(F.count("*").alias("n_apart"), F.min("owner").alias("one_apart"))
        return rows.join(apart, ["seed", "value"], "left").withColumn("owns", F.expr("n_apart is null or n_apart = 1 and one_apart = doc"))

    def by_money(rows: DataFrame) -> DataFrame:
        best = rows.where("owns and money").groupBy("seed", "doc").agg(F.min(F.struct((-F.col("weight")).alias("w"), "value", "other")).alias("x"))
        return best.select("seed", "doc", F.array("x.other").alias("from"), F.lit("reach").alias("kind"), F.array("x.value").alias("values"))

    first = judged(held, inside)
    two = first.where("owns or money or witness").groupBy("seed", "doc").agg(F.sort_array(F.collect_set("other")).alias("from"), F.sort_array(F.collect_set("value")).alias("values"), F.max(F.expr("owns or money")).alias("owned"))
    two = two.where("owned and size(values) >= 2 and size(`from`) >= 2").select("seed", "doc", "from", F.lit("reach").alias("kind"), "values")
    found = two.unionByName(_outside(by_money(first), two))
    settled = inside.select("seed", "doc").unionByName(found.select("seed", "doc"))
    return found.unionByName(_outside(by_money(judged(_outside(held, found), settled)), found))


def window_pairs(edges: DataFrame, dates: DataFrame, n_docs: int) -> DataFrame:
    """Pairs of documents, both ways, whose date edge (a, b, from_day, to_day, weight) lies within a
    week of a matter's date (seed, date) and is not too common: seed, doc, other.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / (DATE_WINDOW + 1))
    weeks = dates.select("seed", "date", F.explode(F.sequence(bucket(F.col("date")) - 1, bucket(F.col("date")) + 1)).alias("bucket"))
    near = edges.where(KIND_WEIGHTS["date"] / F.col("weight") <= REACH_SHARE * n_docs).withColumn("bucket", bucket(F.col("from_day"))).join(weeks, "bucket")
    near = near.where((F.abs(F.datediff("from_day", "date")) <= DATE_WINDOW) & (F.abs(F.datediff("to_day", "date")) <= DATE_WINDOW))
    return near.select("seed", F.col("a").alias("doc"), F.col("b").alias("other")).union(near.select("seed", F.col("b").alias("doc"), F.col("a").alias("other"))).distinct()


def window_links(beside: DataFrame, shared: DataFrame, inside: DataFrame, n_docs: int) -> DataFrame:
    """Documents that stand beside the set in its own week and share values with it."""
    heads = inside.select("seed", F.col("doc").alias("other"))
    near = _outside(beside.join(heads, ["seed", "other"], "left_semi").select("seed", "doc").distinct(), inside)
    met = shared.where(F.col("carriers") <= REACH_SHARE * n_docs).join(heads, "other").join(near, ["seed", "doc"], "left_semi").withColumnRenamed("other", "head")
    return _link(_heaviest(met), "shared", F.collect_set("head"), F.collect_list("value"))


def named_by(nodes: DataFrame) -> DataFrame:
    """Names (ids and file names, upper case) that mean one document: name, doc."""
    names = nodes.select("doc", F.explode(F.array(F.upper("doc"), F.upper(F.element_at(F.split("path", "/"), -1)))).alias("name")).distinct()
    return names.groupBy("name").agg(F.count("*").alias("n"), F.min("doc").alias("doc")).where("n = 1").select("name", "doc")


def compare_links(inside: DataFrame, names: DataFrame, references: DataFrame, sections: DataFrame) -> DataFrame:
    """Documents that one of the set names in a section (anchor, text) that asks for a comparison."""
    asked = references.withColumn("name", F.upper(F.trim("value"))).join(names.withColumnRenamed("doc", "other"), "name").where("other <> doc")
    asked = asked.join(sections.where(F.col("text").rlike(COMPARE_WORDS)).select("anchor"), "anchor", "left_semi").join(inside, "doc")
    first = asked.groupBy("seed", "other").agg(F.min(F.struct("doc", "anchor", "value")).alias("x"))
    found = first.select("seed", F.col("other").alias("doc"), F.array("x.doc").alias("from"), F.lit("compare").alias("kind"), F.array("x.value").alias("values"))
    return _outside(found, inside)


def matter_dates(seeds: DataFrame, core: DataFrame, dated: DataFrame) -> DataFrame:
    """A matter's day: the earliest of the seed's days (doc, day) that another document of the core has, else its earliest: seed, date."""
    own = seeds.join(dated, "doc").select("seed", "day").distinct()
    others = _outside(core, seeds).join(dated, "doc").select("seed", "day").distinct()
    both = own.join(others.withColumn("shared", F.lit(True)), ["seed", "day"], "left")
    return both.groupBy("seed").agg(F.coalesce(F.min(F.when(F.col("shared"), F.col("day"))), F.min("day")).alias("date"))


def money_carried(amounts: DataFrame) -> DataFrame:
    """The largest dollar amount of each document from (doc, value, unit): doc, money."""
    return amounts.where("unit = 'USD'").groupBy("doc").agg(F.max("value").alias("money"))


def ranked_matters(consequences: DataFrame, money: DataFrame, pulls: DataFrame, most: int = 25) -> DataFrame:
    """The first matters by consequences (seed, doc), then by their documents' money, then by pull (seed, pull): seed, n, most, place."""
    sums = consequences.join(money, "doc", "left").groupBy("seed").agg(F.count("*").alias("n"), F.max("money").alias("most"))
    every = pulls.join(sums, "seed", "left").select("seed", "pull", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("most", F.lit(0.0)).alias("most"))
    order = [F.desc("n"), F.desc("most"), F.desc("pull"), "seed"]
    return every.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("seed", "n", "most", "place")


def stands_beside(n_docs: int, size: Column, days_apart: Column) -> Column:
    """A further matter is one of its own: not too few documents, and not too far in time from the first."""
    return (size >= max(2, int(MATTER_SHARE * n_docs))) & (F.abs(days_apart) < MATTER_SPAN)


def covenant_links(flags: DataFrame, core: DataFrame, inside: DataFrame, values: DataFrame) -> DataFrame:
    """Documents whose termination clause shares a run of words with a flag of the core (seed, doc).

    The run tells something (two content words), and the other flag ends an agreement too, or the run
    names a value that notes write (value).  Flags meet by pairs of neighbouring words, so only
    flags with a common pair are compared; a document keeps its first flag's first core flag.
    """
    own = flags.select("doc", "seq", folded_words(F.col("quote")).alias("words"), F.col("quote").rlike(TERMINATION_WORDS).alias("ends"))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, F.lit(2)), " ")))
    ours = own.where("ends").select("doc", "seq", "words", F.explode(pairs).alias("pair"))
    said = own.join(core, "doc").select("seed", F.col("doc").alias("head"), F.col("seq").alias("head_seq"), F.col("words").alias("said"), F.col("ends").alias("both"), F.explode(pairs).alias("pair"))
    met = ours.join(said, "pair").drop("pair").distinct().withColumn("run", shared_run(F.col("words"), F.col("said"))).where("run is not null")
    named = _outside(met, inside).select("*", F.explode(word_runs(F.col("run"))).alias("value")).join(values.select("value").distinct().withColumn("named", F.lit(True)), "value", "left")
    judged = named.groupBy("seed", "doc", "seq", "head", "head_seq", "run").agg(F.max("both").alias("both"), F.max("named").alias("named")).where("both or named")
    first = judged.groupBy("seed", "doc").agg(F.min(F.struct("seq", "head", "head_seq", "run")).alias("x"))
    return first.select("seed", "doc", F.array("x.head").alias("from"), F.lit("covenant").alias("kind"), F.array("x.run").alias("values"))


def grown(seeds: DataFrame, rules: list) -> tuple[DataFrame, DataFrame]:
    """Sets of matters grown from their seeds by rules in order: (seed, doc) and all links.

    A rule takes what is inside so far and returns links; a document's first link stays.
    """
    inside, every = seeds.select("seed", "doc"), None
    for rule in rules:
        found = written(_outside(rule(inside), inside).select("seed", "doc", "from", "kind", "values"), "links")
        every = found if every is None else every.unionByName(found)
        inside = inside.unionByName(found.select("seed", "doc"))
    return inside, every


def ranked_documents(scores: DataFrame, inside: DataFrame) -> DataFrame:
    """Documents of each matter by score (seed, doc, score): those of its set first, lifted by the greatest score; seed, doc, score, place."""
    most = scores.groupBy("seed").agg(F.max("score").alias("most"))
    lifted = scores.join(inside.select("seed", "doc").distinct().withColumn("held", F.lit(True)), ["seed", "doc"], "left").join(most, "seed")
    lifted = lifted.select("seed", "doc", F.coalesce("held", F.lit(False)).alias("held"), F.round(F.col("score") + F.when(F.col("held"), F.col("most")).otherwise(0.0), 6).alias("score"))
    return lifted.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(~F.col("held"), F.desc("score"), "doc"))).select("seed", "doc", "score", "place")
