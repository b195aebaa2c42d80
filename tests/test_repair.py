"""Checks and repairs of reports, against texts written by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import repair, report_checks


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def texts(spark, **own):
    return spark.createDataFrame(list(own.items()), "report string, text string")


@pytest.mark.parametrize(
    ("text", "sentence", "left"),
    [
        ("1. One. Two.\n2. Three.\n", "One.", "1. Two.\n2. Three.\n"),
        ("1. One.\n2. Two.\n", "One.", "2. Two.\n"),
        ("a\n- One.", "One.", "a"),
        ("a\n- One.\n", "One.", "a\n"),
        ("One.\n", "One.", "\n"),
        ("One. and One.", "One.", " and One."),
        ("x One. y", "One.", "x y"),
        ("x", "", "x"),
        ("x", "One.", "x"),
        ("a $1. b", "$1.", "a b"),
    ],
)
def test_a_sentence_is_taken_out(spark, text, sentence, left):
    frame = spark.createDataFrame([(text, sentence)], "t string, s string")
    assert frame.select(repair.taken_out(F.col("t"), F.col("s"))).first()[0] == left


def test_fixes_are_folded_in_order(spark):
    reports = texts(spark, r="1. Alpha is here. Beta is $5.\n2. Gamma.\n", s="Alpha is here.", t="")
    listed = spark.createDataFrame([("r", 1, "Alpha is here."), ("r", 2, "Beta is $5."), ("r", 3, "Gamma."), ("r", 4, "new words"), ("s", 1, "Alpha is here.")], "report string, n int, sentence string")
    # The second fix changes what the first wrote; the fourth no longer finds what the third took out; a number is unknown.
    fixes = spark.createDataFrame([("r", 1, 1, "Alpha has new words."), ("r", 2, 4, "old words"), ("r", 3, 3, " "), ("r", 4, 3, "back"), ("r", 5, 9, "x"), ("r", 6, 2, "Beta is \\$6 $1."), ("s", 1, 1, None)], "report string, at int, n int, sentence string")
    assert rows(repair.apply_fixes(reports, listed, fixes), "report", "text") == [("r", "1. Alpha has old words. Beta is \\$6 $1.\n"), ("s", ""), ("t", "")]


def test_overlapping_fixes(spark):
    reports = texts(spark, r="He paid. He paid late.\n")
    listed = spark.createDataFrame([("r", 1, "He paid."), ("r", 2, "He paid. He paid late.")], "report string, n int, sentence string")
    one = spark.createDataFrame([("r", 1, 1, "She paid."), ("r", 2, 2, "gone")], "report string, at int, n int, sentence string")
    two = spark.createDataFrame([("r", 1, 2, "They paid."), ("r", 2, 1, "gone")], "report string, at int, n int, sentence string")
    assert rows(repair.apply_fixes(reports, listed, one), "text") == [("She paid. He paid late.\n",)]
    assert rows(repair.apply_fixes(reports, listed, two), "text") == [("They paid.\n",)]


def test_failing_sentences(spark):
    failures = spark.createDataFrame([("r", 1, "numbers", "B.", "5"), ("r", 2, "citations", "A.", "none"), ("r", 3, "certainty", "B.", "too sure")], "report string, at int, check string, line string, reason string")
    assert rows(repair.failing_sentences(failures), "n", "sentence", "reasons") == [(1, "B.", "numbers: 5; certainty: too sure"), (2, "A.", "citations: none")]


def test_parts_are_assembled(spark):
    heads = texts(spark, r="## Executive summary\n\nx\n\n\n## Open items\n\n- y\n", s="## Executive summary\n", t="t")
    parts = spark.createDataFrame([("r", 2, "## Lesser issues\n3) three\n  and more\n"), ("r", 1, "## Other\n1. no\n## Lesser issues\n\n1. one\n7. two\n## Open items\n1. no\n"), ("s", 1, "## Lesser issues\n1. one")], "report string, part int, text string")
    lesser = "## Lesser issues\n\n1. one\n2. two\n3. three\n  and more\n"
    got = dict(rows(repair.assembled(heads, parts), "report", "text"))
    assert got["r"] == f"## Executive summary\n\nx\n\n{lesser}\n## Open items\n\n- y\n"
    assert got["s"] == "## Executive summary\n\n## Lesser issues\n\n1. one\n" and got["t"] == "t\n\n## Lesser issues\n\n\n"


def test_further_findings_and_those_left_out(spark):
    report = "# R\n\n## Lesser issues\n\n1. a\n4. b\n\n\n## Open items\n\n- c\n\n## Evidence\n\n- e\n"
    reports = texts(spark, r=report, s="## Lesser issues\n1. a", t=report, u="no such section")
    paragraphs = spark.createDataFrame([("r", 2, "second"), ("r", 1, "first $1"), ("s", 1, "only"), ("u", 1, "x")], "report string, at int, paragraph string")
    got = dict(rows(repair.with_further(reports, paragraphs), "report", "text"))
    assert got["r"] == "# R\n\n## Lesser issues\n\n1. a\n4. b\n\n### Further findings\n\n5. first $1\n6. second\n## Open items\n\n- c\n\n## Evidence\n\n- e\n"
    assert got["s"] == "## Lesser issues\n1. a\n\n### Further findings\n\n2. only\n" and got["t"] == report and got["u"] == "no such section"
    findings = spark.createDataFrame([("r", 2, "b", "D2", "D2#1"), ("r", 1, "a\n  lot", "D1", "D1#1"), ("s", 1, "x", "D", "D#1")], "report string, at int, finding string, doc string, anchor string")
    got = dict(rows(repair.with_left_out(reports, findings), "report", "text"))
    assert got["r"] == report.replace("## Evidence", "## Left out\n\n1. a lot [D1 | D1#1]\n2. b [D2 | D2#1]\n\n## Evidence")
    assert got["s"] == "## Lesser issues\n1. a\n\n## Left out\n\n1. x [D | D#1]\n\n" and got["t"] == report


def test_whole_reports(spark):
    heads = lambda names: "\n".join(f"## {n} \nx" for n in names)
    names = list(repair.HEADINGS)
    cases = [(heads(names), True), (heads([*names, "Evidence"]), True), (heads(names[:-1]), False), (heads([*names[:3], repair.SECOND_HEADING, *names[3:]]), True), (heads([repair.SECOND_HEADING, *names]), False), ("", False)]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").orderBy("k")
    assert [r[0] for r in frame.select(repair.is_whole(F.col("t"))).collect()] == [w for _, w in cases]


REPORT = [
    "# Report",
    "## Findings",
    "1. The pump cost $1,200 [A | a.md#l1] on 5 May 2025. It was late. [A | a.md#l1] [B | b.xlsx#S!B2]",
    "No citation here.",
    "See [A | nowhere] and [C | c.md#l1], [B | a.md#l1].",
    "Calculation: (1,200 + 77 + 9) / 2 = 643",
    "## Evidence",
    "- 99 uncited",
]


def test_citations_and_numbers(spark):
    reports = spark.createDataFrame([("r", k, t) for k, t in enumerate(REPORT)], "doc string, line int, text string")
    sections = spark.createDataFrame([("a.md#l1", "Pump: $1,200 paid", None), ("b.xlsx#S!A2", "77 days", ["A2", "B2"])], "anchor string, text string, cells array<string>")
    cited = {(r["line"], r["at"]): [c["anchor"] for c in r["cites"]] for r in report_checks.cited_sentences(reports).collect()}
    assert cited[2, 1] == ["a.md#l1"] and cited[2, 2] == ["a.md#l1", "b.xlsx#S!B2"] and cited[3, 1] == []
    indexed = spark.createDataFrame([("a.md",), ("b.xlsx",)], "doc string")
    mapping = spark.createDataFrame([("A", "a.md"), ("B", "b.xlsx")], "doc string, path string")
    got = rows(report_checks.check_citations(reports, sections, indexed, mapping), "line", "reason")
    assert got == sorted([
        (2, "the sentence ends in no citation"), (2, "the sentence ends in no citation"), (3, "the sentence ends in no citation"),
        (4, "nowhere is no anchor"), (4, "c.md is on no record of the index"), (4, "c.md#l1 is no section of the room"), (4, "C is on no document of the map"), (4, "B is b.xlsx, not a.md"),
    ], key=str)
    numbers = rows(report_checks.check_numbers(reports, sections), "line", "reason")
    assert numbers == [(2, "2025-05-05 is in no cited section"), (5, "9 is on no cited sentence of the section")]
    dossier = spark.createDataFrame([(1, "- 2025-05-05 | A | Pump | a.md#l1"), (2, "- 9 | A | x | a.md#l1")], "matter int, line string")
    assert rows(report_checks.check_numbers(reports, sections, dossier), "line", "reason") == [(5, "9 is on no cited sentence of the section")]
