from pyspark.sql import functions as F

from tessera.functions.words import folded_words, shared_run
from tessera.operators import dossier, links
from tests.test_links import rows


def test_shared_runs(spark):
    pairs = [("either party may terminate upon written notice today", "a right to terminate upon written notice"), ("in the event of a", "in the event of a"), ("x", "y")]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string").orderBy("k")
    assert [r[0] for r in frame.select(shared_run(folded_words(F.col("a")), folded_words(F.col("b")))).collect()] == ["terminate upon written notice", None, None]


def test_rules_in_order(spark):
    flags = spark.createDataFrame([("A", 0, "Harbor may terminate upon written notice"), ("D", 1, "We terminate upon written notice"), ("E", 0, "upon written notice"), ("G", 0, "Termination of the Tidewater DPA follows"), ("A", 1, "The Tidewater DPA is open")], "doc string, seq int, quote string")
    seeds = spark.createDataFrame([(1, "A")], "seed int, doc string")
    values = spark.createDataFrame([("tidewater dpa",)], "value string")
    versions = spark.createDataFrame([("A", "F")], "draft string, final string")
    inside, every = links.grown(seeds, [lambda s: links.version_links(versions, s), lambda s: links.covenant_links(flags, seeds, s, values)])
    assert rows(every, "doc", "kind", "from", "values") == [("D", "covenant", ("A",), ("terminate upon written notice",)), ("F", "version", ("A",), ("A", "F")), ("G", "covenant", ("A",), ("the tidewater dpa",))]
    assert rows(inside, "doc") == [("A",), ("D",), ("F",), ("G",)]
    scores = spark.createDataFrame([(1, "A", 1.5), (1, "D", 0.2), (1, "X", 0.9)], "seed int, doc string, score double")
    assert rows(links.ranked_documents(scores, inside), "place", "doc", "score") == [(1, "A", 3.0), (2, "D", 1.7), (3, "X", 0.9)]


def test_comparisons(spark):
    note = "matter int, doc string, seq int, quote string, anchor string"
    flags = spark.createDataFrame([(1, "A", 0, "The retention limit is thirty", "A#1"), (1, "B", 0, "Agreement terminates at once", "B#1"), (1, "C", 0, "open point", "C#1"), (1, "A", 1, "Agreement terminates", "A#2")], note)
    seeds = spark.createDataFrame([(1, "C")], "matter int, doc string")
    assert rows(dossier.covenant_rows(flags, seeds), "clause_anchor", "seed_anchor") == [("A#2", "C#1"), ("B#1", "C#1")]
    pairs = spark.createDataFrame([(1, "A", "B")], "matter int, draft string, final string")
    assert rows(dossier.version_rows(pairs, flags), "a_anchor", "b_anchor", "shared") == [("A#2", "B#1", 2)]
    figures = spark.createDataFrame([(1, "A", 0, "30 days", "Retained for 30 days", "A#1"), (1, "B", 0, "$5m", "a reserve of $5m, not $4m", "B#2"), (1, "B", 1, "$4m", "a reserve of $4m", "B#3"), (1, "C", 0, "$9m", "costs of $7m to $9m", "C#2"), (1, "C", 1, "45 days", "kept 45 days, not 30 days", "C#3")], note.replace("quote string", "surface string, quote string"))
    assert rows(dossier.reserve_rows(figures), "reserve_anchor", "estimate_anchor") == [("B#2", "C#2")]
    assert rows(dossier.policy_rows(flags, figures), "limit_anchor", "practice_anchor", "number", "unit") == [("A#1", "C#3", "30", "day")]
    assert rows(dossier.figures_in_order(figures, spark.createDataFrame([("B",)], "doc string")), "place", "anchor") == [(1, "B#2"), (2, "B#3")]
    own = spark.createDataFrame([("M", 0, "7", "the plan", "M#1"), ("M", 1, "410", "a forecast of 410", "M#2"), ("A", 0, "410", "410", "A#1"), ("N", 0, "410", "no word", "N#1")], "doc string, seq int, number string, quote string, anchor string")
    dated = spark.createDataFrame([("M", "2025-02-01"), ("N", "2025-02-01")], "doc string, day string")
    found = dossier.models_after(own, dated, spark.createDataFrame([(1, "2025-01-05")], "seed int, date string"), spark.createDataFrame([(1, "410")], "seed int, number string"), spark.createDataFrame([(1, "A")], "seed int, doc string"))
    assert rows(found, "doc", "figure", "anchor") == [("M", "410", "M#2")]


def test_order_of_findings(spark):
    findings = spark.createDataFrame([(1, 1, "X"), (1, 2, "L"), (1, 3, "A"), (2, 1, "A"), (2, 2, "L")], "report int, place int, doc string")
    documents = spark.createDataFrame([(1, "A"), (2, "A")], "report int, doc string")
    lesser = spark.createDataFrame([(1, "L"), (1, "A"), (2, "L")], "report int, doc string")
    assert rows(dossier.order_failures(findings, documents, lesser), "report", "place") == [(1, 1), (1, 2)]
