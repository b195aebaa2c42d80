import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import index, links, ranking, report, verify


def rows(df, *columns):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect())


def references(spark, items):
    return spark.createDataFrame([(d, k, kind, v, "q", f"{d}#l{k}") for k, (d, kind, v) in enumerate(items)], "doc string, seq int, kind string, value string, quote string, anchor string")


def test_names_fall_into_groups(spark):
    own = references(spark, [("A", "person", "Priya Raman"), ("B", "person", "P. Raman"), ("C", "name", "Raman, Priya"), ("C", "name", "Priya Ramna"), ("D", "name", "VistaPort"), ("E", "code", "Vista Port"), ("E", "name", "Vista-Port")])
    groups = links.name_groups(own)
    keys = {r["form"]: (r["key"], r["spelling"]) for r in groups.collect()}
    assert keys["praman"] == keys["priyaraman"] == ("praman", "P. Raman") and keys["priyaramna"] != keys["priyaraman"] and keys["vistaport"] == ("vistaport", "Vista-Port")
    assert rows(links.person_values(own, groups), "name") == [("praman",)]
    assert links.name_groups(own.limit(0)).count() == 0


def test_what_notes_write(spark):
    own = references(spark, [("A", "code", "Tidewater DPA"), ("A", "person", "Ann"), ("B", "ticket", " dr-1 "), ("B", "ticket", "B")])
    figures = spark.createDataFrame([("A", "Net 45 days"), ("B", "45 days")], "doc string, surface string")
    assert rows(links.written_values(own, figures), "value") == [("45 days",), ("b",), ("dr 1",), ("net 45 days",), ("tidewater dpa",)]
    assert ("dpa",) in rows(links.reference_runs(own), "run") and ("45 days", "A") in rows(links.figure_writers(figures), "run", "doc")
    assert rows(links.citations(own, spark.createDataFrame([("A",), ("B",), ("DR-1",)], "doc string")), "citing", "cited") == [("B", "DR-1")]
    flags = spark.createDataFrame([("A", ["Legacy_UAP", "twenty-four (24) months"])], "doc string, about array<string>")
    hidden = spark.createDataFrame([("A", 1, "No claim", "of Harbor"), ("B", 1, "x", "y")], "doc string, seq int, claim string, quote string")
    said = {r["doc"]: r for r in links.about(flags, hidden, links.name_groups(own)).collect()}
    assert said["A"]["values"] == ["legacy uap", "twenty four 24 months"] and said["A"]["hidden"] == "no claim of harbor" and said["B"]["values"] == []
    frame = spark.createDataFrame([(["legacy uap", "twenty four 24 months"], "no claim of harbor", v) for v in ("legacy uap", "legacy", "24 months", "4 months", "harbor", "")], "v array<string>, h string, f string")
    assert [r[0] for r in frame.select(links.is_about(F.col("v"), F.col("h"), F.col("f"))).collect()] == [True, False, True, False, True, False]


def edges(spark, items):
    return spark.createDataFrame(items, "a string, b string, kind string, value string, weight double")


def test_rules_take_documents_in(spark):
    own = edges(spark, [("A", "B", "identifier", "X-1", 0.5), ("A", "B", "cross-reference", "X-1", 2.0), ("A", "C", "identifier", "X-2", 0.25), ("B", "C", "date", "2025-01-01", 0.1), ("A", "C", "identifier", "15", 0.5), ("B", "D", "identifier", "X-3", 0.5)])
    shared = links.value_links(own)
    assert rows(shared.where("doc = 'A'"), "other", "value", "weight", "carriers") == [("B", "X-1", 2.0, 2), ("C", "X-2", 0.25, 4)]
    seeds = spark.createDataFrame([(1, "A"), (2, "B")], "seed int, doc string")
    assert rows(links.shared_links(seeds, shared), "seed", "doc", "from", "values") == [(1, "B", ("A",), ("X-1",)), (1, "C", ("A",), ("X-2",)), (2, "A", ("B",), ("X-1",)), (2, "D", ("B",), ("X-3",))]
    pairs = spark.createDataFrame([("A", "F"), ("C", "G")], "draft string, final string")
    assert rows(links.version_links(pairs, seeds), "seed", "doc", "from", "values") == [(1, "F", ("A",), ("A", "F"))]
    broken = spark.createDataFrame([(1, "T", "2025-01-03")], "seed int, doc string, period string")
    assert rows(links.break_links(broken, seeds), "doc", "from", "values") == [("T", ("A",), ("2025-01-03",))]
    figures = spark.createDataFrame([("A", "$410m"), ("B", "410"), ("M", "410")], "doc string, surface string")
    modelled = spark.createDataFrame([(1, "M", "410")], "seed int, doc string, figure string")
    assert rows(links.model_links(modelled, figures, seeds), "doc", "from", "values") == [("M", ("A",), ("410",))]
    numbers = spark.createDataFrame([("615m",), ("$1,234.50",), ("4100",), ("x",), ("1234567",), ("0",)], "v string")
    assert [r[0] for r in numbers.select(links.figure_number(F.col("v"))).collect()] == ["615", "1234.5", "4100", None, "1.23457e+06", "0"]


def test_reach_is_read_twice(spark):
    # D holds two codes of the set; E and F each hold the other's money figure, so only the second reading lets the second one in.
    held = [("A", "D", "C-1", 1.0), ("B", "D", "C-2", 1.0), ("A", "E", "$7", 1.0), ("B", "F", "$7", 1.0), ("A", "G", "C-1", 1.0), ("A", "E", "$8", 0.5), ("E", "F", "$7", 1.0)]
    shared = links.value_links(edges(spark, [(a, b, "identifier", v, w / 3) for a, b, v, w in held]))
    inside = spark.createDataFrame([(1, "A"), (1, "B")], "seed int, doc string")
    runs = spark.createDataFrame([("c 1",), ("c 2",), ("7",), ("8",)], "run string")
    none = spark.createDataFrame([], "value string, doc string")
    naming = spark.createDataFrame([("C-1", "A"), ("C-2", "B"), ("$7", "E"), ("$7", "F")], "value string, doc string")
    readers = spark.createDataFrame([("8", "E")], "run string, doc string")
    found = links.reach_links(shared, inside, 20, runs, naming, readers, runs.where("run <> '8'"))
    assert rows(found, "doc", "from", "values") == [("D", ("A", "B"), ("C-1", "C-2"))]
    naming = naming.where("doc <> 'F'")
    found = links.reach_links(shared, inside, 20, runs, naming, readers, runs.where("run <> '8'"))
    assert rows(found, "doc", "from", "values") == [("D", ("A", "B"), ("C-1", "C-2")), ("E", ("A",), ("$7",)), ("F", ("B",), ("$7",))]
    assert links.reach_links(shared, inside, 4, runs, none, readers, runs).count() == 0


def test_weeks_and_comparisons(spark):
    day = lambda d: dt.date(2025, 1, d)
    dated = spark.createDataFrame([("A", "H", day(2), day(4), 0.45), ("A", "I", day(2), day(4), 0.01), ("A", "J", day(2), day(20), 0.45)], "a string, b string, from_day date, to_day date, weight double")
    dates = spark.createDataFrame([(1, day(3))], "seed int, date date")
    beside = links.window_pairs(dated, dates, 20)
    assert rows(beside, "doc", "other") == [("A", "H"), ("H", "A")]
    shared = links.value_links(edges(spark, [("A", "H", "identifier", "V", 0.5), ("A", "I", "identifier", "V", 0.5)]))
    inside = spark.createDataFrame([(1, "A")], "seed int, doc string")
    assert rows(links.window_links(beside, shared, inside, 20), "doc", "from", "values") == [("H", ("A",), ("V",))]
    nodes = spark.createDataFrame([("B", "x/plan.pdf"), ("C", "y/plan.pdf"), ("A", "a.pdf")], "doc string, path string")
    own = references(spark, [("A", "code", "b"), ("A", "code", "plan.pdf"), ("A", "code", "C")])
    sections = spark.createDataFrame([("A#l0", "Compare it with b."), ("A#l2", "See C.")], "anchor string, text string")
    assert rows(links.compare_links(inside, links.named_by(nodes), own, sections), "doc", "from", "values") == [("B", ("A",), ("b",))]
    dated = spark.createDataFrame([("A", "2025-01-05"), ("A", "2025-01-02"), ("B", "2025-01-05"), ("C", "2025-01-09")], "doc string, day string")
    core = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C")], "seed int, doc string")
    assert rows(links.matter_dates(spark.createDataFrame([(1, "A"), (2, "C")], "seed int, doc string"), core, dated), "seed", "date") == [(1, "2025-01-05"), (2, "2025-01-09")]
    money = links.money_carried(spark.createDataFrame([("A", 5.0, "USD"), ("A", 9.0, "USD"), ("B", 99.0, "days")], "doc string, value double, unit string"))
    places = links.ranked_matters(spark.createDataFrame([(1, "A"), (2, "B")], "seed int, doc string"), money, spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 9.0)], "seed int, pull double"))
    assert rows(places, "place", "seed", "n", "most") == [(1, 1, 1, 9.0), (2, 2, 1, 0.0), (3, 3, 0, 0.0)]


def test_series_break_in_the_week(spark):
    day = lambda d: dt.date(2025, 1, d)
    cells = [(s, s, c, day(k + 1), float(v)) for s, c, values in (("s", "x", [10, 11, 10, 11, 10, 14, 18, 22]), ("s", "y", [1, 2, 1, 2, 1, 2, 1, 9]), ("t", "x", [10, 11, 10, 11, 10, 14, 18, 22])) for k, v in enumerate(values)]
    frame = spark.createDataFrame(cells, "series string, doc string, column string, at date, value double")
    dates, seeds = spark.createDataFrame([(1, day(5))], "seed int, date date"), spark.createDataFrame([(1, "t")], "seed int, doc string")
    broken, before = ranking.series_breaks(frame, dates, seeds)
    assert rows(broken, "doc", "period") == [("s", day(6))] and rows(before, "number", "n") == [(10.0, 3), (11.0, 2)]
    assert ranking.series_breaks(frame, spark.createDataFrame([(1, day(20))], "seed int, date date"), seeds)[0].count() == 0


def test_folds_and_orders(spark):
    sizes = spark.createDataFrame([("r", k, n) for k, n in enumerate([5, 4, 20, 1, 1, 9], 1)] + [("s", k, 6) for k in range(300)] + [(None, 1, 5)], "room string, place int, size int").repartition(3)
    groups = ranking.within_budget(sizes, 10)
    assert rows(groups.where("room = 'r'"), "place", "group") == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (6, 4)]
    assert rows(groups.where("room = 's'"), "place", "group") == [(k, k + 1) for k in range(300)] and rows(groups.where("room is null"), "place", "group") == [(1, 1)]
    ids = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "c", 3), ("s", "a", 1)], "room string, id string, place int")
    reply = spark.createDataFrame([("r", "c", 1), ("r", "z", 2), ("r", "c", 3), ("r", "a", 4), ("s", "b", 1)], "room string, id string, at int")
    assert rows(ranking.in_reply_order(ids, reply), "room", "rank", "id") == [("r", 1, "c"), ("r", 2, "a"), ("r", 3, "b"), ("s", 1, "a")]
    flagged = spark.createDataFrame([("r", "A", "$5"), ("r", "B", "$7"), ("r", "C", "no"), ("s", "A", "$1"), ("r", "D", "$9")], "room string, doc string, surface string")
    lesser = report.lesser(flagged, spark.createDataFrame([("r", "D")], "room string, doc string"))
    assert rows(lesser, "room", "place", "doc") == [("r", 1, "B"), ("r", 2, "A"), ("r", 3, "C"), ("s", 1, "A")]
    lines = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "b"), (1, 3, "cccccc")], "doc int, line int, text string")
    assert rows(ranking.pieces_halved(lines), "doc", "cut") == [(1, 3)]
    hits = spark.createDataFrame([("r", "f", 1, True), ("r", "f", 2, True), ("r", "g", 1, True), ("r", "g", 2, False)], "row string, fact string, pass int, hit boolean")
    assert rows(ranking.agreement(hits), "row", "agreed", "recall") == [("r", 0.5, 0.75)]
    passing = spark.createDataFrame([("m", 2.0, True, True), ("n", 1.0, True, False), ("o", 3.0, True, True)], "model string, dollars double, clean boolean, full boolean")
    assert rows(ranking.cheapest_passing(passing), "model", "dollars") == [("m", 2.0)]
    assert rows(ranking.ask_scores(spark.createDataFrame([("d", 1, 0.2), ("d", 1, 0.6), ("d", 2, 0.0)], "doc string, ask int, score double")), "doc", "score") == [("d", 0.3)]


def test_reports(spark):
    lines = ["# Title", "## Findings", "1. First [A | A#l1].", "Calculation: 1 + 1", "", "## Evidence", "### Plan", '- 2025 | "a | b" | [A | A#l1]', "- other", "## Left out", "- x"]
    own = spark.createDataFrame([("r", k, t) for k, t in enumerate(lines)] + [("s", 0, "none")], "doc string, line int, text string")
    assert rows(report.cited_lines(own), "line", "text") == [(2, "First [A | A#l1].")]
    assert rows(report.without_sections(own), "doc") == [("s",)]
    assert rows(report.evidence_rows(own), "document", "date", "quote", "citation") == [("Plan", "", "other", ""), ("Plan", "2025", "a | b", "[A | A#l1]")]
    dossier = spark.createDataFrame([("r", 1, "Comparisons", "- D1 | q | D1#l3 || D2 | r | D2#l4"), ("r", 2, "Names", "- n | D1 | q | D1#l3"), ("r", 3, "Models blind to it", "- m | D3 | q | D3#l1")], "doc string, line int, section string, text string")
    assert rows(report.document_weights(dossier), "document", "weight") == [("D1", 4), ("D2", 3), ("D3", 3)]
    flags = spark.createDataFrame([(1, "A", 1, "There is no material claim.", "A#l1"), (1, "B", 1, "Materiality is pending.", "B#l1"), (1, "A", 2, "Materiality is deferred.", "A#l2")], "matter int, doc string, seq int, quote string, anchor string")
    assert rows(report.warranties(flags), "said_doc", "open_doc") == [("A", "B")]
    unique = report.unique_title_words(spark.createDataFrame([("A", ["harbor", "msa"]), ("B", ["granite", "msa"])], "doc string, words array<string>"))
    assert rows(report.worried_about(unique, spark.createDataFrame([("A", ["granite", "harbor"])], "doc string, words array<string>")), "doc") == [("B",)]


def test_findings_and_facts(spark):
    findings = spark.createDataFrame([(1, "d.pdf#p1l1", "The pump cost $1,200 to repair"), (2, "d.pdf#p1l2", "Turbine broken beyond repair"), (3, "e.pdf#p1l1", "Nothing")], "id int, anchor string, finding string")
    paragraphs = spark.createDataFrame([("The pump [d.pdf | d.pdf#p1l1]",), ("cost 1200 [d.pdf | d.pdf#p1l1]",), ("A turbine [d.pdf | d.pdf#p1l2]",)], "text string")
    assert rows(verify.uncarried(findings, paragraphs), "id") == [(2,), (3,)]
    quotes = spark.createDataFrame([("A", 2, "we  found a leak here", "A#l2"), ("A", 1, "a leak", "A#l1")], "doc string, seq int, quote string, anchor string")
    asked = spark.createDataFrame([(1, "A", "a leak"), (2, "A", "found a leak"), (3, "A", "no"), (4, "B", "a leak")], "id int, doc string, quote string")
    kept, dropped = verify.kept_findings(asked, quotes, spark.createDataFrame([("A",)], "doc string"))
    assert rows(kept, "id", "anchor") == [(1, "A#l1"), (2, "A#l2")] and rows(dropped, "id", "reason") == [(3, "quote not found"), (4, "no such document in the group")]
    facts = spark.createDataFrame([("r", 1, "document", "", ["A-1", "B-2"]), ("r", 2, "comparison", "reserve of $1,200 against 45 days on 18 October 2025", ["A-1"]), ("r", 3, "number", "12 million", ["B-2"]), ("r", 4, "number", "13m", ["B-2"]), ("s", 5, "document", "", ["A-1"]), ("t", 6, "document", "", ["A-1"])], "report string, fact int, kind string, value string, documents array<string>")
    text = spark.createDataFrame([("r", "Reserves were 1200 (a-1), 45 days from 2025-10-18. US$12m b-2"), ("s", "Nothing of A-1")], "report string, text string")
    assert {r["fact"]: r["hit"] for r in verify.recalled(facts, text).collect()} == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False}
    cited = spark.createDataFrame([(1, "It is confirmed", "a"), (2, "It may be", "a"), (3, "It is likely", "b"), (4, "confirmed", "a"), (4, "confirmed", "c")], "id int, text string, anchor string")
    held = spark.createDataFrame([("a", "it may be"), ("b", "nothing"), ("c", "It is certain")], "anchor string, text string")
    assert rows(verify.too_certain(cited, held), "id", "rung", "held", "word") == [(1, 3, 1, "confirmed"), (3, 2, 0, "likely")]
    assert rows(verify.failures_by_check(spark.createDataFrame([("x",), ("x",)], "check string"), ["x", "y"]), "check", "n") == [("x", 2), ("y", 0)]


def test_names_within_sentences_and_families(spark):
    lines = spark.createDataFrame([(1, 1, "Then Harbor paid. Harbor said so, Acme"), (2, 1, "We met Harbor and Harbor"), (2, 2, "Then Then")], "doc long, line long, text string")
    assert rows(index.one_word_names(lines), "value", "n") == [("Harbor", 4)]
    paths = spark.createDataFrame([("x/P_2025_01.pdf",), ("x/P_2025_02.pdf",), ("x/P_2025_03.pdf",), ("y/Q_2025_01.pdf",), ("y/Q_2025_03.pdf",), ("z.pdf",)], "doc string")
    assert rows(index.document_series(paths), "stem", "step", "n", "first", "last") == [("P", "month", 3, "2025-01", "2025-03")]
    assert rows(index.first_dates(spark.createDataFrame([(1, 1, "x"), (1, 2, "on 3 May 2025"), (1, 3, "2024-01-01")], "doc long, line long, text string")), "doc", "day") == [(1, "2025-05-03")]
