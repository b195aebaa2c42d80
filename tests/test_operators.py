import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph, index, ranking, sections, verify
from tessera.plans import matters, noted, rooms, typed, written  # noqa: F401
from tessera.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value != value or str(value) == "NaT":
        return "~"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value).replace(" 00:00:00", "")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = duck.execute(SQL[name]).df()
    assert sorted(want.columns) == columns
    rows = lambda frame: sorted(tuple(plain(v) if not isinstance(v, int) else plain(float(v)) for v in r) for r in frame[columns].itertuples(index=False))
    assert rows(found.toPandas()) == rows(want)


def test_blocks_and_headings(spark):
    docs = spark.createDataFrame([(1, "\n1. Scope\n\na\nb\n  \nTERMS\nc"), (2, ""), (3, None)], "doc_id long, text string")
    lines = sections.lines(docs)
    got = [tuple(r) for r in sections.blocks(lines).orderBy("doc", "line").collect()]
    assert got == [(1, 2, 1, "1. Scope"), (1, 4, 2, "a\nb"), (1, 7, 2, "TERMS\nc")]
    headed = {r["line"]: r["heading"] for r in sections.headed(lines).where("doc = 1").collect()}
    assert headed[1] is None and headed[4] == "1. Scope" and headed[8] == "TERMS"


def test_line_table_header(spark):
    docs = spark.createDataFrame([(1, "Item | Revenue ($M)\nA | 1,200\nB | -3.5\n7\nend\nx\n12")], "doc_id long, text string")
    cells = sections.line_cells(sections.line_runs(sections.lines(docs)))
    assert [(r["line"], r["cell"], r["number"]) for r in cells.where("number is not null").orderBy("line", "cell").collect()] == [(2, 2, 1200.0), (3, 2, -3.5), (4, 1, 7.0)]
    assert [r["text"] for r in sections.table_headers(cells).orderBy("cell").collect()] == ["Item", "Revenue ($M)"]


def test_packing_never_splits_a_section(spark):
    rows = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([3, 4, 10, 1, 1], 1)], "doc long, line long, text string")
    got = [(r["first"], r["last"], r["chars"]) for r in sections.packed_pieces(rows, 8).orderBy("piece").collect()]
    assert got == [(1, 2, 8), (3, 3, 10), (4, 5, 3)]


def test_numbers(spark):
    values = ["912.8m", "1.1bn", "$12,400,000", "45", "TB", ""]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in frame.select(X.scaled_value(frame["v"])).collect()] == [912_800_000.0, 1_100_000_000.0, 12_400_000.0, 45.0, None, None]
    assert [r[0] for r in frame.select(X.is_count(frame["v"])).collect()] == [False, False, False, True, False, False]


def test_dates_that_do_not_exist_are_none(spark):
    docs = spark.createDataFrame([(1, "2025-13-40 then 2025-10-18 and 2025-10-18")], "doc_id long, text string")
    assert [(r["value"], r["n"]) for r in index.dates(sections.lines(docs)).collect()] == [("2025-10-18", 2)]


def test_ambiguous_versions_drop_out(spark):
    day = lambda d: dt.date(2025, 1, d)
    rows = [("A", 1, "draft", day(1)), ("A", 2, "final", day(2)), ("B", 3, "draft", day(1)), ("B", 4, "draft", day(2)), ("B", 5, "final", day(3)), ("C", 6, "draft", day(9)), ("C", 7, "final", day(3))]
    got = index.version_pairs(spark.createDataFrame(rows, "identifier string, doc long, status string, day date")).collect()
    assert [(r["draft"], r["final"]) for r in got] == [(1, 2)]


def test_values_that_are_too_common_do_not_link(spark):
    rows = [("identifier", v, d) for v, docs in {"x": [1, 2], "y": [1, 2, 3, 4], "z": [1]}.items() for d in docs]
    carriers = spark.createDataFrame(rows, "kind string, value string, doc long")
    assert [(r["a"], r["b"], r["value"], r["weight"]) for r in graph.value_edges(carriers, 2).collect()] == [(1, 2, "x", 0.5)]
    assert graph.value_edges(carriers, 4).count() == 7


def test_date_edges_of_all_orders_pass_forty_documents(spark, tmp_path):
    day = dt.date(2025, 1, 1)
    spark.createDataFrame([(k, day) for k in range(50)], "o_custkey long, o_orderdate date").toPandas().to_parquet(f"{tmp_path}/orders.parquet")
    spark.range(100).toPandas().to_parquet(f"{tmp_path}/customer.parquet")
    assert QUERIES["q18b_date_edges_all"](spark, str(tmp_path)).count() == 50 * 49 // 2


def test_turn_and_prefix(spark):
    series = {"wobbles": [10, 11, 10, 11, 10, 14, 18, 22], "falls": [9, 8, 9, 8, 4, 0, -4, -5], "two": [1, 1, 1, 5, 9, 9], "short": [1, 5, 9, 13], "steady": [1, 2, 3, 4, 5]}
    rows = [(s, k, float(v)) for s, values in series.items() for k, v in enumerate(values)]
    got = ranking.turn_index(spark.createDataFrame(rows, "series string, at long, value double")).collect()
    assert sorted((r["series"], r["at"], r["n"], r["step"], r["usual"]) for r in got) == [("falls", 4, 5, -4.0, 1.0), ("wobbles", 5, 6, 4.0, 1.0)]
    ranked = spark.createDataFrame([("g", k, c) for k, c in enumerate([5, 3, 9, 1], 1)], "g string, rank int, cost long")
    assert [r["rank"] for r in ranking.choose(ranked, 10, ["g"]).collect()] == [1, 2]


def test_quotes_are_found_where_they_stand(spark):
    quotes = spark.createDataFrame([(1, "one two three"), (2, "none of these"), (3, "")], "quote long, text string")
    docs = spark.createDataFrame([(7, "x one two three"), (8, "one two"), (9, None)], "doc long, text string")
    assert [tuple(r) for r in verify.located(quotes, docs).collect()] == [(1, 7, 3)]


def test_short_quotes_are_found_where_they_stand(spark):
    texts = ["one", "one two", "ne tw", "o", "tw", " two", "e ", "two\nthree", "\n", "é x", "zzz", "one"]
    quotes = list(enumerate(texts, 1))
    docs = [(7, "x one two three"), (8, "none twofold"), (9, None), (10, "two\nthree"), (11, "café xy"), (12, ""), (7, "one")]
    got = verify.located(spark.createDataFrame(quotes, "quote long, text string"), spark.createDataFrame(docs, "doc long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((q, d, t.find(x) + 1) for q, x in quotes for d, t in docs if t and x in t)


def test_recall_of_short_and_blank_quotes_equals_sql(spark, tmp_path):
    items = [(1, "two"), (2, ""), (3, "  "), (4, "     "), (5, None), (6, "wo th"), (7, "q"), (8, "\n")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).toPandas().to_parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "one two three  four"), (2, None)], "doc_id long, text string").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    for name in ("q27_quote_location", "q28_planted_recall"):
        found = QUERIES[name](spark, str(tmp_path))
        want = con.execute(SQL[name]).df()[found.columns]
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.itertuples(index=False)))


def test_amounts_days_and_headers(spark):
    want = {
        "$12,400,000": (12_400_000.0, "USD"), "912.8m": (912_800_000.0, None), "912,800,000 records": (912_800_000.0, "records"), "1.1bn": (1.1e9, None), "30.1%": (30.1, "percent"),
        "45-day": (45.0, "days"), "45 days": (45.0, "days"), "36-month": (36.0, "months"), "twenty-four (24) months": (24.0, "months"), "": None, "TB": None, "no digits here": None,
    }
    got = spark.createDataFrame([(k,) for k in want], "s string").select("s", X.amount(F.col("s")).alias("a")).collect()
    assert {r["s"]: r["a"] and (round(r["a"]["value"], 3), r["a"]["unit"]) for r in got} == want
    days = {"18 October 2025": "2025-10-18", "11 Dec 2025": "2025-12-11", "October 18, 2025": "2025-10-18", "2025-10-18T02:14:07Z": "2025-10-18", "[2025-10-23 09:10 UTC]": "2025-10-23"}
    days |= dict.fromkeys(["2025-13-40", "18 Octember 2025", "October", "2025", ""])
    got = spark.createDataFrame([(k,) for k in days], "s string").select("s", X.day(F.col("s")).cast("string").alias("d")).collect()
    assert {r["s"]: r["d"] for r in got} == days
    scales = {"Revenue ($M)": 1e6, "Cost (USD bn)": 1e9, "in thousands": 1.0, "Count": 1.0}  # a scale counts in brackets or after a dollar sign only
    got = spark.createDataFrame([(k,) for k in scales], "s string").select("s", X.header_scale(F.col("s")).alias("x")).collect()
    assert {r["s"]: r["x"] for r in got} == scales
