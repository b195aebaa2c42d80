from pyspark.sql import functions as F

from tessera.functions import anchors as A
from tessera.functions import carry
from tessera.functions import dates as D
from tessera.functions import rows as R
from tessera.functions import text as X
from tessera.functions import words as W
from tessera.operators import verify


def of(spark, values, f, kind="string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in frame.orderBy("k").select(f(F.col("v"))).collect()]


def test_names(spark):
    assert of(spark, ["kid=vpauth-legacy-2019", "  A  b ", "É1", "--"], W.fold) == ["kid vpauth legacy 2019", "a b", "1", ""]
    forms = of(spark, ["Priya Raman", "P. Raman", "Raman, Priya", "VistaPort", "Vista-Port", "Acme Holdings Ltd.", "Group", "", "One Two Three"], W.name_forms)
    assert forms[0] == ["priyaraman", "praman"] and forms[1] == ["praman"] and set(forms[2]) == {"ramanpriya", "rpriya", "priyaraman", "praman"}
    assert forms[3] == ["vistaport"] and forms[4] == ["vistaport", "vport"] and forms[5] == ["acmeholdings", "aholdings"] and forms[6] == ["group"] and forms[7] == [] and forms[8] == ["onetwothree"]
    assert sorted(of(spark, ["a b a", ""], W.word_runs)[0]) == ["a", "a b", "a b a", "b", "b a"]
    assert of(spark, ["x/Cyber_Notice_Draft.v2.eml"], W.name_words) == ["Cyber Notice Draft v2"] and of(spark, ["x/Cyber_Notice.v2.eml"], W.title_of) == ["Cyber Notice"]
    assert of(spark, ["The Vista & Port Group of Acme Corp, Inc"], W.phrases)[0] == ["The Vista", "The Vista & Port", "Vista & Port", "Vista & Port Group", "Port Group", "Acme Corp"]
    assert of(spark, ["Said he. ", "said ", "", "line\n", "( "], W.mid_sentence) == [False, True, False, False, False]
    assert of(spark, ["DR-", "a ", "$", "1.", "-", " -"], W.joined_to_a_token) == [True, False, False, True, False, False]
    words = "no party may assign or shall not terminate to a claim".split()
    assert sorted(of(spark, [words], W.verbs, "array<string>")[0]) == ["assign"]
    assert of(spark, [words, ["may", "terminate"]], lambda w: W.negated(w, F.lit("terminate")), "array<string>") == [True, False]


def test_anchors(spark):
    shapes = ["d#p2t1r3", "d#p2l14", "a#b#m3l14", "d#l14", "d#r14", "d#Sheet 1!AB14", "d#x", "nothing", "#l1"]
    got = of(spark, shapes, A.parse_anchor)
    assert [g and g["kind"] for g in got] == ["page-table-row", "page-line", "message-line", "line", "row", "sheet-cell", None, None, None]
    assert (got[0]["page"], got[0]["table"], got[0]["row"]) == (2, 1, 3) and got[2]["doc"] == "a#b" and (got[5]["sheet"], got[5]["column"], got[5]["row"]) == ("Sheet 1", "AB", 14)
    assert of(spark, ["AB12", "r3c4", "t1r2c3", "c9", "x"], A.column_of) == ["AB", "c4", "c3", "c9", None]
    assert of(spark, ["d#S!A1", "d#r3", "d#p2t1r3", "d#l1"], A.table_of) == ["S", "", "p2t1", None]


def test_days_and_periods(spark):
    text = "On 18 October 2025, Oct. 3, 2025 and 2025-10-23; not 2025-13-40, 31 February 2025 or 18 Octember 2025."
    assert of(spark, [text], D.days_in) == [["2025-10-18", "2025-10-03", "2025-10-23"]]
    assert of(spark, ["a 2025-10-23 b"], D.mask_days) == ["a            b"]
    periods = ["2025-10-18", "2025-10-18T02:00Z", "18 October 2025", "2025-09", "September 2025", "FY2025-Q3", "Q3 2025", "2025", "Octember 2025", "2025-13"]
    assert [p and tuple(p) for p in of(spark, periods, D.period)] == [("day", 2025, 10, 18)] * 3 + [("month", 2025, 9, 0)] * 2 + [("quarter", 2025, 3, 0)] * 2 + [None] * 3
    pairs = [("2025-01-01", "2025-01-08"), ("2025-01-01", "2025-01-02"), ("2024-12", "2025-01"), ("2024-10", "2025-01"), ("Q4 2024", "Q1 2025"), ("2025-01", "Q1 2025")]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string").orderBy("k")
    assert [r[0] for r in frame.select(D.step_between(D.period(F.col("a")), D.period(F.col("b")))).collect()] == ["week", None, "month", "quarter", "quarter", None]
    got = of(spark, ["x/Monthly_Finance_Pack_2025_09.pdf", "a/Q3_2025 b.xlsx", "FY2023.pdf"], D.name_period)
    assert (got[0]["stem"], got[0]["after"], tuple(got[0]["period"])) == ("Monthly_Finance_Pack", ".pdf", ("month", 2025, 9, 0)) and tuple(got[1]["period"]) == ("quarter", 2025, 3, 0) and got[2] is None


def test_carry(spark):
    assert of(spark, ["days", "drafted", "creation", "was", "findings", "the", "is"], carry.stem) == ["day", "draft", "creat", "was", "find", "the", "is"]
    assert of(spark, ["“a”  **b** _c_ snake_case 2*3", "* x", "_ x", "a * b", "x *", "a_b_c", "_"], carry.straighten) == ['"a" b c snake_case 23', "x", "x", "a * b", "x", "a_b_c", ""]
    assert of(spark, ["US$1,200,000 and 12 million, 3m"], carry.normalised) == ["1200000 and 12m, 3m"]
    assert sorted(of(spark, ["1,200 on 2025-10-18 and 7"], carry.numbers_of)[0]) == ["1200", "7"]
    pairs = [("It cost $1,200 to repair the broken pump.", "The pump repair cost 1200"), ("It cost 1300.", "cost $1,200"), ("", "x"), ("broken", "the broken turbine"), ("Costs 99", "costs 12")]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string").orderBy("k")
    assert [r[0] for r in frame.select(carry.carries(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, True]
    assert of(spark, ["paid $12.5m (30.1%) of 45 days, $ 3 and (7) months"], carry.amount_surfaces) == [["$12.5m", "30.1%", "$ 3"]]
    assert of(spark, ["One. Two? Three", "a | b | 5"], carry.units) == [["One.", "Two?", "Three"], ["a", "b", "5"]]
    assert of(spark, ["Revenue ($M)", "Share %", "Record count", "Term months", "Name"], X.header_unit) == ["USD", "percent", "records", "months", None]
    assert of(spark, [" historical profile records", " days", " 5 days", " percentage", " percent"], X.following_unit) == ["records", "days", None, None, "percent"]
    assert of(spark, ["Revenue ($M)", "$000s", "(USD bn)", "Members", "(millions)", "Month"], X.header_scale) == [1e6, 1e3, 1e9, 1.0, 1e6, 1.0]


def test_rows(spark):
    line = "- 5 | D1 | a | b | D1#l3"
    assert of(spark, [line, "- short"], R.row_quote) == ["a | b", "- short"]
    assert of(spark, [line], R.evidence_line) == ['- 5 | "a | b" | [D1 | D1#l3]']
    assert of(spark, ["- D1 | q | D1#l3 || D2 | r | s | D2#l4"], R.comparison_line) == ['- D1 says "q" [D1 | D1#l3] against D2 says "r | s" [D2 | D2#l4]']
    cites = of(spark, ["So [D1 | D1#l3]. And [x.pdf#p2l3][D2 | D2#l4]."], R.citations)[0]
    assert [tuple(c) for c in cites] == [("D1", "D1#l3"), ("x.pdf", "x.pdf#p2l3"), ("D2", "D2#l4")]
    assert [len(x) for x in of(spark, ["So [D1 | D1#l3]. And [x.pdf#p2l3] [D2 | D2#l4].", "none [D1 | D1#l3] here"], R.trailing_citations)] == [2, 0]
    assert of(spark, ["Yes [D1 | D1#l3].", "No [D1 | D1#l3] x"], R.is_cited) == [True, False]


def test_numbers_with_sources(spark):
    assert of(spark, ["It cost $185,000.00 (30.1%) by 18 October 2025 for DR-069 [D1 | D1#l4]."], carry.sentence_numbers) == [["185000.00", "30.1"]]
    assert sorted(of(spark, ["a 30.1 b"], carry.source_numbers)[0]) == ["1", "30", "30.1"]
    assert of(spark, ["Calculation: ($1,200 + 800) / 2 = 1000, range 900 to 1,100", "5 + 6 = 11"], carry.calculation_operands) == [["1200", "800", "900", "1100"], ["5", "6"]]
    cited = spark.createDataFrame([(1, "It cost 1,200 on 2025-10-18.", "a"), (2, "It cost 7.", "a"), (2, "It cost 7.", "b"), (3, "It cost 9.", "z")], "id int, text string, anchor string")
    sources = spark.createDataFrame([("a", "cost $1200, 18 October 2025"), ("b", "7 days")], "anchor string, text string")
    assert sorted(map(tuple, verify.unsourced_numbers(cited, sources).collect())) == [(3, "9")]


def test_periods_are_days_of_the_calendar_months_and_quarters(spark):
    said = ["2025-02-28", "2024-02-29T10:00", " 2025-01-06 ", "2025-02-29", "2025-13-01", "0000-01-01", "5 May 2025", "31 June 2025", "2025-07", "2025-00", "May 2025", "FY2025 Q3", "q4-2025", "12", "", None]
    frame = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string").orderBy("k")
    want = ["2025-02-28", "2024-02-29", "2025-01-06", None, None, None, "2025-05-05", None, "2025-07", None, "2025-05", "2025-Q3", "2025-Q4", None, None, None]
    assert [r[0] for r in frame.select(D.period_text(D.period(F.col("s")))).collect()] == want
