"""Variants of rooms: scans that write nothing twice, dealt spellings, planted values."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import rewriting as W
from tessera.operators import variants

NAMES = {"Clear Water": "Open Harvest", "Maple & Dunn": "Cedar & Pike", "MERLIN": "Clear Water", "Dunn": "Moss"}


def of(spark, texts, function):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in frame.orderBy("k").select(function(F.col("t"))).collect()]


def test_names_keep_separator_and_case_and_are_written_once(spark):
    texts = ["The Clear_Water and CLEAR-WATER, clear  water.", "Maple&Dunn met MAPLE & DUNN; Dunn left", "merlin MERLINS xMERLIN", ""]
    assert of(spark, texts, lambda c: W.write_names(c, NAMES)) == ["The Open_Harvest and OPEN-HARVEST, Open  Harvest.", "Cedar & Pike met CEDAR & PIKE; Moss left", "Clear Water MERLINS xMERLIN", ""]


@pytest.mark.parametrize(("written", "grown"), [("$12,400.50", "$21,080.85"), ("999", "1698"), ("1,000", "1,700"), ("0.05", "0.09"), ("30.1%", "51.2%"), ("5", "9"), ("£ 3 m", "£ 5 m"), ("999,999", "1,699,998"), ("0", "0")])
def test_numbers_keep_their_format(spark, written, grown):
    assert of(spark, [written], lambda c: W.multiplied(c, Decimal("1.7"))) == [grown]


def test_one_scan_of_identifiers_days_and_numbers(spark):
    texts = ["NQ-17 on 2024-02-29 cost $1,000 for 12 months in Q3 2025, FY 2024, May 2023 and 1999; 18 October 2025 was 30.1%. v1.2_x.gz 2024-05 5,000.25 a1b2 1 900"]
    want = ["NQ-17-AB on 2017-02-28 cost $1,700 for 20 months in Q3 2018, FY 2017, May 2016 and 1992; 18 October 2018 was 51.2%. v1.2_x.gz-AB 2017-05 8,500.43 a1b2 2 1530"]
    assert of(spark, texts, lambda c: W.rewritten(c, {}, 7, "1.7", "-AB")) == want


def test_a_replacement_is_never_read_again(spark):
    assert of(spark, ["MERLIN Clear Water"], lambda c: W.rewritten(c, NAMES, 1, "2", "-X")) == ["CLEAR WATER Open Harvest"]
    assert of(spark, ["2 3"], lambda c: W.rewritten(c, {"x": "2"}, 1, "2", "-X")) == ["4 6"]


def test_spellings_are_dealt_and_guarded_runs_stay(spark):
    sections = spark.createDataFrame([(f"d{k}", f"d{k}#1", "Ann Lee wrote to Ann; ann.lee@x.com, Ann/Lee, Ann7 and see Ann.pdf") for k in range(9)] + [("e", "e#1", "Only ann@x.com")], "doc string, anchor string, text string")
    names = spark.createDataFrame([("Ann Lee", ["ANN LEE", "A. Lee", "Lee, Ann"]), ("Ann", ["Anne"]), ("Bob", ["Rob"])], "name string, spellings array<string>")
    drawn = variants.dealt(sections, names)
    rows = {(r["doc"], r["name"]): r["spelling"] for r in drawn.collect()}
    assert {d for d, _ in rows} == {f"d{k}" for k in range(9)} and {n for _, n in rows} == {"Ann Lee", "Ann"}
    dealt = [s for (_, n), s in rows.items() if n == "Ann Lee"]
    assert sorted(map(dealt.count, set(dealt))) == [3, 3, 3]
    assert rows == {(r["doc"], r["name"]): r["spelling"] for r in variants.dealt(sections.repartition(5), names).collect()}
    texts = {r["doc"]: r["text"] for r in variants.rewrite_names(sections, drawn).collect()}
    assert texts["d3"] == f"{rows['d3', 'Ann Lee']} wrote to Anne; ann.lee@x.com, Ann/Lee, Ann7 and see Ann.pdf" and texts["e"] == "Only ann@x.com"


def test_planted_values(spark):
    facts = spark.createDataFrame([("f1", 1, "quote", "The Pump  broke"), ("f2", 2, "identifier", "Maple & Dunn"), ("f3", 3, "number", "45 days"), ("f4", 4, "date", "2025-10-18"), ("f5", 5, "identifier", "NQ-17"), ("f6", 6, "quote", "")], "fact string, at int, kind string, value string")
    texts = ["so the pump broke.", "maple&dunn", "within 45   days", "145 days", "on 18 October 2025", "2025-10-18", "x2025-10-18-1", "NQ-17-AB", "see nq-17; 45 days", "nothing"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["fact"] for r in variants.planted(frame, facts).collect()}
    assert got == {0: "f1", 1: "f2", 2: "f3", 4: "f4", 5: "f4", 8: "f3"}
