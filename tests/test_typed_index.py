"""The typed index of a small room, against values derived by hand."""

import datetime as dt
import re

import pytest

from tessera.operators import typed_index as T


def text(doc, k, said, heading=None):
    return (doc, k, "text", heading, f"{doc}#l{k}", said, None)


def cells(doc, k, sheet, *values):
    held = [(f"{chr(64 + i)}{k}", str(v), float(v) if isinstance(v, int | float) else None) for i, v in enumerate(values, 1)]
    return (doc, k, "row", None, f"{doc}#{sheet}!A{k}", " | ".join(map(str, values)), held)


@pytest.fixture(scope="module")
def sections(spark):
    rows = [
        text("a/Note_Draft.md", 1, "Status DRAFT\nDate 12 November 2025"),
        text("a/Note_Draft.md", 2, "We met Harbor Lane & Co on 18 October 2025 about NQ-17 and v1.2_final.tar.gz."),
        text("a/Note_Draft.md", 3, "It cost $12.4m over twenty-four (24) months, 30.1% of 912.8m records; 45-day notice, room 5 and DR-024.", "1. Costs"),
        text("b/Note.md", 1, "CONFIDENTIAL\nDate 14 November 2025 (Final)"),
        text("b/Note.md", 2, "Then Harbor paid 3 days later, see NQ-17 and MERLIN."),
        text("b/Note.md", 3, "Week | Revenue ($M) | Churn (%)"),
        *[text("b/Note.md", 4 + k, f"2025-0{1 + (k >= 4)}-{7 * k + 6 - (31 if k >= 4 else 0):02d} | {1.5 + k} | {k}") for k in range(5)],
        text("b/Note.md", 9, "7"),
        text("b/Note.md", 10, "end of MERLIN"),
        cells("c/Plan_2025_01.xlsx", 1, "S", "Month", "Cost (USD k)", "Note"),
        *[cells("c/Plan_2025_01.xlsx", 2 + k, "S", m, 10 + k, "Big Pump") for k, m in enumerate(["Jan 2025", "March 2025", "April 2025", "May 2025"])],
        cells("c/Plan_2025_02.xlsx", 1, "S", "2025 Q1", 1),
        cells("c/Plan_2025_02.xlsx", 2, "S", "Q2 2025", 2),
        cells("c/Plan_2025_02.xlsx", 3, "S", "FY2025 Q3", 3),
        cells("c/Plan_2025_02.xlsx", 4, "T", "2025-01-01", 3),
        text("c/Plan_2025_03.xlsx", 1, "MERLIN"),
    ]
    return spark.createDataFrame(rows, T.SECTIONS).repartition(3)


@pytest.fixture(scope="module")
def index(sections):
    return T.records(T.build_index(sections)).collect()


def of(index, kind):
    return {(r["value"], r["unit"]): (r["surface"], r["n_docs"], r["anchor"]) for r in index if r["kind"] == kind}


def test_dates(index):
    assert set(of(index, "date")) >= {("2025-11-12", None), ("2025-10-18", None), ("2025-11-14", None), ("2025-01-06", None)}


def test_amounts_of_texts_and_their_units(index):
    found = {k: v[0] for k, v in of(index, "amount").items()}
    assert found["12400000", "USD"] == "$12.4m" and found["24", "months"] == "(24) months" and found["30.1", "percent"] == "30.1%"
    assert found["912800000", "records"] == "912.8m records" and found["45", "days"] == "45-day" and found["5", "count"] == "5" and found["3", "days"] == "3 days"
    assert ("24", "count") not in found and ("17", "count") not in found


def test_amounts_of_cells_take_unit_and_scale_of_their_header(index):
    found = of(index, "amount")
    assert found["1500000", "USD"] == ("1.5", 1, "b/Note.md#l4") and found["4", "percent"][2] == "b/Note.md#l8"
    # A number alone below a table is a row of it.
    assert found["10000", "USD"] == ("10", 1, "c/Plan_2025_01.xlsx#S!B2") and found["2", "count"][2] == "c/Plan_2025_02.xlsx#S!B2"


def test_names_and_identifiers(index):
    names = of(index, "name")
    assert names["Harbor", None][1] == 2 and ("Harbor Lane", None) in names and ("Lane & Co", None) in names and ("Harbor Lane & Co", None) in names
    assert names["Big Pump", None][2] == "c/Plan_2025_01.xlsx#S!C2"
    assert ("MERLIN", None) not in names or names["MERLIN", None][1] >= 2
    assert {k[0] for k in of(index, "identifier")} == {"NQ-17", "v1.2_final.tar.gz", "DR-024"}


def test_statuses(index):
    rows = sorted((r["value"], r["surface"], r["anchor"]) for r in index if r["kind"] == "status")
    assert rows == [("confidential", "CONFIDENTIAL", "b/Note.md#l1"), ("draft", "DRAFT", "a/Note_Draft.md#l1"), ("final", "Final", "b/Note.md#l1")]


def test_version_pair(index):
    assert of(index, "version-pair") == {("a/Note_Draft.md -> b/Note.md", None): ("NQ-17", 2, "a/Note_Draft.md#l1")}


def test_series(index):
    rows = {r["context"]: (r["value"].split(" ")[0], r["surface"]) for r in index if r["kind"] == "series"}
    assert rows == {
        "5 week rows from 2025-01-06 to 2025-02-03": ("week", "Week"),
        "3 quarter rows from 2025-Q1 to 2025-Q3": ("quarter", "A"),
        "3 month rows from 2025-03 to 2025-05": ("month", "Jan 2025"),  # a short month is no period
        "3 month documents from 2025-01 to 2025-03": ("month", "Plan"),
    }


def test_series_as_numbers(sections):
    got = sorted((r["column"], r["at"], r["value"], r["anchor"]) for r in T.series_numbers(sections).collect())
    weeks = [dt.date(2025, 1, 6) + dt.timedelta(days=7 * k) for k in range(5)]
    assert got == [("c2", w, 1.5 + k, f"b/Note.md#l{4 + k}") for k, w in enumerate(weeks)] + [("c3", w, float(k), f"b/Note.md#l{4 + k}") for k, w in enumerate(weeks)]


def test_an_ambiguous_identifier_and_a_document_in_two_pairs_give_no_pair(spark):
    rows = []
    for doc, status, day, code in (("a", "Draft", 1, "X-1"), ("b", "Final", 2, "X-1"), ("c", "Final", 3, "X-1"), ("d", "Draft", 1, "Y-1"), ("e", "Final", 2, "Y-1"), ("e", "Final", 2, "Z-1"), ("f", "Draft", 1, "Z-1")):
        rows += [text(doc, 1 if code != "Z-1" or doc != "e" else 2, f"It is {status}\n2025-01-0{day} on {code}")]
    pairs = T.records(T.build_index(spark.createDataFrame(rows, T.SECTIONS))).where("kind = 'version-pair'")
    assert pairs.count() == 0


def test_an_empty_room(spark):
    assert T.build_index(spark.createDataFrame([], T.SECTIONS)).count() == 0


def test_pieces_are_dealt_evenly_before_amounts_are_read(spark):
    rows = [(f"d{k % 5}", k, "text", None, f"d#l{k}", f"On 2024-05-06 it cost $1,2{k % 10}0k over 12 months", None) for k in range(400)]
    sections = spark.createDataFrame(rows, T.SECTIONS).coalesce(1)
    pieces = T.text_pieces(sections)
    found = T.amounts(sections, pieces, T.line_rows(sections))
    assert found.where("unit in ('USD', 'months')").groupBy("unit").count().orderBy("unit").collect() == [("USD", 400), ("months", 400)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Amounts are read above the step that deals the pieces out.
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression")


def test_members_of_series_are_counted_without_joins(spark):
    weeks = [f"2025-01-{6 + 7 * k:02d}" for k in range(3)]
    rows = [text("x", 1, "Week | Sold | Left"), *[text("x", 2 + k, f"{w} | {k} | {'' if k == 1 else 7}") for k, w in enumerate(weeks)], text("x", 5, "all | 3 | 9")]
    rows += [text("x", 6, "no row"), text("x", 7, "Month | Sold"), *[text("x", 8 + k, f"2025-0{k + 1} | {k}") for k in range(3)]]
    rows += [text("y", 1, "Day | Sold"), *[text("y", 2 + k, f"2025-02-{28 + k} | {k}") for k in range(3)]]
    sections = spark.createDataFrame(rows, T.SECTIONS).repartition(3)
    found = T.series_numbers(sections)
    # The months begin with no day, a week has nothing left, and February had no 29th.
    assert sorted((r["doc"], r["column"], str(r["at"]), r["value"], r["surface"], r["anchor"]) for r in found.collect()) == [("x", "c2", w, float(k), "Week", f"x#l{2 + k}") for k, w in enumerate(weeks)]
    # Tables are joined with their series, and with nothing else.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_a_series_is_headed_by_the_cell_above_and_rows_are_numbered_within_their_table(spark):
    rows = [text("x", 1, "Plan | Q"), text("x", 2, "text"), text("x", 3, "Quarter | Sum"), *[text("x", 4 + k, f"Q{k + 1} 2025 | {k}") for k in range(4)], text("x", 9, " | 2025-01"), *[text("x", 10 + k, f" | 2025-0{k + 2}") for k in range(2)]]
    sections = spark.createDataFrame(rows, T.SECTIONS).repartition(3)
    before = T.line_rows(sections)
    assert {(r["table"], r["ordinal"]): r["row"] for r in before.collect()} == {("lines1", 1): 1, **{("lines3", k): n for n, k in enumerate([3, 4, 5, 6, 7, 9, 10, 11], 1)}}
    found = T.row_series(sections, T.line_tables(sections))
    got = sorted((r["table"], r["column"], r["step"], r["n"], r["first"], r["last"], r["surface"], r["anchor"], r["from_row"], r["to_row"]) for r in found.collect())
    assert got == [("lines3", "c1", "quarter", 4, "2025-Q1", "2025-Q4", "Quarter", "x#l3", 2, 5), ("lines3", "c2", "month", 3, "2025-01", "2025-03", "3", "x#l7", 6, 8)]
    # Only the rows above a series are read again, by a look-up, not all rows.
    assert "Join LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_documents_are_read_once_for_a_document(spark, sections, tmp_path):
    sections.write.parquet(f"{tmp_path}/sections")
    own = spark.read.parquet(f"{tmp_path}/sections")
    plan = T.build_index(own)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scans = [i for i, line in enumerate(plan) if "Relation [doc#" in line and "cells#" in line]
    # Before, the filter on a period in the name went below the grouping of documents, to the sections.
    above = [line for i in scans for line in plan[i - 2 : i] if "Filter" in line]
    assert scans and not [line for line in above if re.search(r"[A-Za-z_]+\((?:upper\(|lower\(|split\(|trim\()*doc#", line.replace("isnotnull(doc#", ""))]
