"""What readers chose, recall over notes, rubrics, prices and records, against rows written by hand."""

import glob
import json

from pyspark.sql import functions as F

from tessera.operators import choices as C
from tessera.sources import records
from tests.test_links import rows

FINDINGS = "room string, group int, place int, doc string, finding string, quote string, anchor string"


def findings(spark):
    return spark.createDataFrame([("r", 2, 1, "B", "late | again", '"Paid  late"', "B#1"), ("r", 1, 2, "A", "", "the leak", "A#2"), ("r", 1, 1, "A", "leak", "the leak", "A#1"), ("r", 2, 2, "A", "leak", "“the leak”", "A#1"), ("s", 1, 1, "Z", "z", "zz", "Z#1")], FINDINGS)


NODES = [("r", "B", 1, "Bill"), ("r", "A", 2, None), ("r", "C", 3, "none"), ("s", "Z", 1, "Zed")]


def test_findings_by_document(spark):
    nodes = spark.createDataFrame(NODES, "room string, doc string, place int, title string")
    found = C.by_document(findings(spark), nodes)
    assert rows(found.where("room = 'r'"), "rank", "at", "anchor") == [(1, 1, "B#1"), (2, 1, "A#1"), (2, 2, "A#2"), (2, 3, "A#1")]
    texts = {r["room"]: r["text"] for r in C.findings_digest(found, "What a reader chose.").collect()}
    assert texts["r"] == (
        "# Digest\n\nWhat a reader chose.\n\n### Documents\n\n- 1. B | Bill | - | - | -\n- 2. A | A | - | - | -\n\n### 1. B | Bill\n\n- late / again | B | Paid late | B#1\n\n"
        "### 2. A | A\n\n- leak | A | the leak | A#1\n- - | A | the leak | A#2\n- leak | A | the leak | A#1\n"
    )
    proofs = {r["room"]: r["text"] for r in C.findings_evidence(found).collect()}
    assert proofs["r"] == '### B | Bill\n\n- late / again | "Paid late" | [B | B#1]\n\n### A | A\n\n- leak | "the leak" | [A | A#1]\n- - | "the leak" | [A | A#2]\n'
    seen = spark.createDataFrame([("r", "He  said: the\nleak.")], "room string, text string")
    assert rows(C.unseen(findings(spark), seen), "room", "anchor") == [("r", "B#1"), ("s", "Z#1")]


def test_notes_of_chosen_documents(spark):
    chosen = spark.createDataFrame([("r", "B", 1, "Bill"), ("r", "A", 2, None)], "room string, doc string, rank int, title string")
    flags = spark.createDataFrame([("A", 1, "leak", "cost", "q1", "A#1"), ("X", 0, "x", "x", "x", "X#1")], "doc string, seq int, flag string, consequence string, quote string, anchor string")
    figures = spark.createDataFrame([("A", 0, "$5m", "q2", "A#2"), ("B", 0, "3", "q3", "B#1")], "doc string, seq int, surface string, quote string, anchor string")
    items = C.chosen_items(chosen, flags, figures)
    assert rows(items, "rank", "at", "finding") == [(1, 1, "3"), (2, 1, "leak Consequence: cost"), (2, 2, "$5m")]
    assert C.findings_evidence(items).first()["text"].startswith('### B | Bill\n\n- 3 | "q3" | [B | B#1]\n')


def test_parts_and_caps(spark):
    counts = spark.createDataFrame([("r", 1, "A", 40), ("r", 2, "B", 30), ("r", 3, "C", 90), ("r", 4, "D", 5)], "room string, place int, doc string, n int")
    assert rows(C.document_parts(counts, 70), "doc", "part") == [("A", 1), ("B", 1), ("C", 2), ("D", 3)]
    assert [r[0] for r in spark.createDataFrame([(1,), (4,), (149,), (151,)], "g int").select(C.group_cap(F.col("g"))).collect()] == [150, 38, 2, 1]


def test_recall_over_notes(spark):
    facts = spark.createDataFrame([(1, "The Pump", ["a.md", "b.md"]), (2, "pump", ["b.md"]), (3, "x", [])], "fact int, value string, documents array<string>")
    items = spark.createDataFrame([("a.md", "so the PUMP-broke"), ("c.md", "pump")], "doc string, quote string")
    assert rows(C.planted_recall(facts, items), "fact", "hit") == [(1, True), (2, False), (3, False)]


def test_rubrics_and_prices(spark):
    replies = spark.createDataFrame([("r", '```json\n[{"id": 1, "points": 9, "reason": "ok"}, {"id": 2, "points": -3}]\n```'), ("s", "no list"), ("t", "so [] it is")], "report string, text string")
    rubric = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "id int, points int")
    assert rows(C.rubric_rows(replies, rubric), "report", "id", "points", "reason") == [("r", 1, 5, "ok"), ("r", 2, 0, "no reason given"), ("r", 3, 0, "no reason given"), ("t", 1, 0, "no reason given"), ("t", 2, 0, "no reason given"), ("t", 3, 0, "no reason given")]
    calls = spark.createDataFrame([(1, "m", 2_000_000, 500_000), (2, "free", 5, 5), (3, "unknown", 1, 1)], "id int, model string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("m", 1.5, 4.0), ("free", 0.0, 0.0)], "model string, rate_in double, rate_out double")
    assert {r["id"]: r["dollars"] for r in C.priced(calls, prices).collect()} == {1: 5.0, 2: 0.0, 3: None}


def test_values_in_pieces_and_runs(spark):
    named = spark.createDataFrame([("A", 0, "NQ-17"), ("A", 1, "--"), ("A", 2, "Harbor Lane"), ("B", 0, "NQ-17")], "doc string, seq int, value string")
    pieces = spark.createDataFrame([("A", 1, "see nq 17"), ("A", 2, "the HARBOR\nlane, NQ-17")], "doc string, piece int, text string")
    assert rows(C.named_in_pieces(named, pieces), "piece", "value") == [(1, "NQ-17"), (2, "Harbor Lane"), (2, "NQ-17")]
    runs = spark.createDataFrame([(1, "the tidewater dpa is"), (2, "is the")], "id int, run string")
    assert rows(C.naming_runs(runs, spark.createDataFrame([("tidewater dpa",)], "value string")), "id") == [(1,)]


def test_records_on_disk(spark, tmp_path):
    evidence = spark.createDataFrame([("Plan", "2025", 'a "b", c', "[A | A#1]"), ("Plan", None, "d\ne", "")], "document string, date string, quote string, citation string").coalesce(1)
    records.write_evidence(evidence, f"file://{tmp_path}/e")
    (part,) = glob.glob(f"{tmp_path}/e/part-*")
    assert open(part, "rb").read().decode() == '\ufeffdocument,date,quote,citation\r\nPlan,2025,"a ""b"", c",[A | A#1]\r\nPlan,,"d\ne",\r\n'
    sections = spark.createDataFrame([("a", "d", None, "x", [("A1", "5")]), ("b", "d", "h", 'y"}', None)], "anchor string, doc string, heading string, text string, cells array<struct<ref: string, value: string>>")
    got = [json.loads(r["value"]) for r in records.section_records(sections).collect()]
    assert got == [{"anchor": "a", "cells": [{"ref": "A1", "value": "5"}], "doc": "d", "heading": None, "text": "x"}, {"anchor": "b", "doc": "d", "heading": "h", "text": 'y"}'}]
    assert [list(g) == sorted(g) for g in got] == [True, True]
    docs, edges = spark.createDataFrame([("A",)], "doc string"), spark.createDataFrame([("A", "B", "k", "v")], "a string, b string, kind string, value string")
    records.write_map(docs, edges, f"file://{tmp_path}/m", spark.createDataFrame([(1, "A")], "matter int, seed string"), spark.createDataFrame([(1, 1, "A")], "matter int, place int, doc string"))
    assert {p.split("/")[-1] for p in glob.glob(f"{tmp_path}/m/*")} == {"documents", "edges", "matters", "ranked"}
