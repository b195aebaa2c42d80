"""The dossier of a matter, its comparisons and its markdown, against texts written by hand."""

import pytest

from tessera.operators import dossier_text as T

SCHEMAS = {
    "flags": "doc string, seq int, flag string, quote string, anchor string",
    "figures": "doc string, seq int, surface string, quote string, anchor string",
    "references": "doc string, seq int, kind string, value string, quote string, anchor string",
    "concealed": "doc string, seq int, quote string, anchor string",
}
NODES = "doc string, path string, folder string, date string, status array<string>"
SECTIONS = "doc string, anchor string, text string, ordinal int"
SET = "matter int, doc string"


def notes(spark, **tables):
    return T.Notes(**{k: spark.createDataFrame(tables.get(k, []), schema) for k, schema in SCHEMAS.items()})


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_a_document_that_denies_the_matter_is_out_and_one_that_is_named_stays(spark):
    clause = "on a change of control either party may terminate this agreement"
    denial = "a change of control shall not entitle either party to terminate this agreement"
    flags = [("A", 0, "f", clause, "A#1"), ("B", 0, "f", denial, "B#1"), ("C", 0, "f", denial, "C#1"), ("D", 0, "f", "Granite is unreserved", "D#1"), ("E", 0, "f", "it may not terminate", "E#1")]
    nodes = spark.createDataFrame([(d, p, "", None, []) for d, p in (("A", "Meridian_MSA.pdf"), ("B", "Harbor_MSA.pdf"), ("C", "Granite_MSA.pdf"), ("D", "Memo.pdf"), ("E", "Other_Memo.pdf"), ("S", "Cap_Table.xlsx"))], NODES)
    cluster = spark.createDataFrame([(m, d) for m in (1, 2) for d in "ABCDES"], SET)
    seeds = spark.createDataFrame([(1, "A"), (2, "S")], SET)
    own = notes(spark, flags=flags)
    held = rows(T.matter_sets(cluster, seeds, nodes, own), "matter", "doc")
    # B denies; C does too, but D worries about it by name; E shares no telling run.  The seed of matter 2 has no note.
    assert held == [(1, d) for d in "ACDES"] + [(2, d) for d in "ABCDES"]


def test_quotes_of_table_rows_name_nobody(spark):
    nodes = spark.createDataFrame([("A", "Harbor.pdf", "", None, []), ("B", "List.pdf", "", None, [])], NODES)
    cluster = spark.createDataFrame([(1, "A"), (1, "B")], SET)
    table = notes(spark, flags=[("B", 0, "f", "Harbor | 5", "B#1")])
    plain = notes(spark, flags=[("B", 0, "Harbor owes", "x", "B#1")])
    assert rows(T.worried_about(cluster, nodes, table.flags), "doc") == []
    assert rows(T.worried_about(cluster, nodes, plain.flags), "doc") == [("A",)]


def test_asked_against_answered(spark):
    nodes = spark.createDataFrame([("D1", "memo.md", "", None, []), ("D2", "revenue_summary.xlsx", "", None, []), ("D3", "z.md", "", None, [])], NODES)
    references = notes(spark, references=[("D1", 0, "other", "Revenue_Summary.xlsx", "q", "D1#2"), ("D1", 1, "other", "D3", "q", "D1#1"), ("D3", 0, "other", "D1", "q", "D3#1")]).references
    sections = spark.createDataFrame(
        [
            ("D1", "D1#1", "See D3 for churn.", 1),
            ("D1", "D1#2", "Compare the churned accounts with revenue_summary.xlsx for Harbor region", 2),
            ("D1", "D1#3", "Harbor region lost twelve accounts", 3),
            ("D2", "D2#1", "Revenue summary revenue", 1),
            ("D2", "D2#2", "Harbor region | accounts | 12 lost", 2),
            ("D2", "D2#3", "Harbor region | accounts | 13", 3),
            ("D3", "D3#1", "Reconcile with D1: zzz", 1),
        ],
        SECTIONS,
    )
    sets = spark.createDataFrame([(1, "D1"), (1, "D2"), (1, "D3"), (2, "D1")], SET)
    got = rows(T.compare_rows(sets, nodes, references, sections), "matter", "doc", "anchor")
    assert got == [(1, "D1", "D1#2"), (1, "D1", "D1#3"), (1, "D2", "D2#2")]


def test_models_against_series(spark):
    own = notes(
        spark,
        figures=[("M", 0, "$410m", "the forecast assumes 410", "M#1"), ("B", 0, "410", "410 on 5 January 2025", "B#1"), ("B", 1, "390", "390 on 12 January 2025", "B#2"), ("B", 2, "1", "no day", "B#3")],
        flags=[("M", 0, "f", "the forecast is stale", "M#2"), ("M", 1, "f", "nothing shared", "M#3"), ("B", 0, "f", "turned on 2025-01-12", "B#4"), ("B", 1, "f", "turned on 2025-01-19", "B#5")],
    )
    consequences = spark.createDataFrame([(1, "model-after", "M", None, "2025-02-01", "410", "M#1"), (1, "series-break", "B", "weekly", "2025-01-12", None, "B#9")], "matter int, kind string, doc string, series string, period string, figure string, anchor string")
    sets = spark.createDataFrame([(1, "M"), (1, "B")], SET)
    assert rows(T.model_rows(sets, consequences, own), "doc", "anchor") == [("B", "B#2"), ("B", "B#4"), ("M", "M#1"), ("M", "M#2")]
    assert T.model_rows(sets.where("doc = 'M'"), consequences, own).count() == 0


def test_deadline_against_act(spark):
    own = notes(
        spark,
        figures=[("P", 0, "45 days", "Notice must be given within 45 days", "P#1"), ("Q", 0, "45 days", "notice within 45 days", "Q#2")],
        flags=[("Q", 0, "f", "sent on 3 March 2025, beyond 45 days", "Q#3")],
    )
    sections = spark.createDataFrame([("P", "P#1", "Notice must be given within 45 days", 1), ("Q", "Q#1", "Re: your notice", 1), ("Q", "Q#4", "Dated 1 March 2025", 2), ("T", "T#1", "Ticket 7 opened 2 January 2025", 1), ("T", "T#2", "Ticket 8 opened 1 February 2025", 2)], SECTIONS)
    sets = spark.createDataFrame([(1, d) for d in "PQT"], SET)
    assert rows(T.deadline_rows(sets, own, sections), "doc", "anchor") == [("P", "P#1"), ("Q", "Q#1"), ("Q", "Q#4"), ("T", "T#1")]


def test_rows_of_the_same_documents_are_one_line(spark):
    parts = spark.createDataFrame([(1, "r1", "B", "b", "B#1"), (1, "r1", "A", "", "A#2"), (1, "r2", "A", "a", "A#1"), (1, "r2", "B", "b", "B#1"), (1, "r3", "A", "x", "A#9"), (1, "r3", "C", "c", "C#1"), (2, "r1", "B", "b", "B#1")], "matter int, row string, doc string, quote string, anchor string")
    assert rows(T.comparison_lines(parts), "matter", "place", "line") == [(1, 1, "- A | a | A#1 || A | - | A#2 || B | b | B#1"), (1, 2, "- A | x | A#9 || C | c | C#1"), (2, 1, "- B | b | B#1")]


WANTED = """## Matter 1

Seed A. Date 2025-01-10.

### Documents

- 1. A | Incident Memo | room | 2025-01-10 | draft
- 3. B | Second Agreement | - | - | -

### Timeline

- 2025-01-10 | A | The leak was found | A#1
- 2025-01-12 | A | Paid $5m on 12 January 2025 | A#2
- 2025-02-01 | B | Dated 1 February 2025 | B#7
- - | B | It may be material | B#1

### Names

- NQ-17 | A | q / r | A#3
- NQ-17 | B | see NQ-17 | B#3

### Figures

- $5m | A | Paid $5m on 12 January 2025 | A#2

### Models blind to it

- 2025-01-14 | B | series-break weekly | B#6

### Comparisons

- A | The leak was found | A#1 || B | It may be material | B#1

### Lesser matters

- $9m | X | A lesser thing | X#1
- - | Y | No money | Y#1
"""


def test_the_markdown_of_a_matter(spark):
    own = notes(
        spark,
        flags=[("A", 0, "f", "The leak was found", "A#1"), ("B", 0, "f", "It may be material", "B#1"), ("X", 0, "f", "A lesser thing", "X#1"), ("X", 1, "f", "second", "X#2"), ("Y", 0, "f", "No money", "Y#1")],
        figures=[("A", 0, "$5m", "Paid $5m on 12 January 2025", "A#2"), ("X", 0, "$9,000,000", "q", "X#3"), ("X", 1, "$2", "q", "X#4")],
        references=[("A", 0, "ticket", "NQ-17", "q / r", "A#3"), ("B", 0, "code", "NQ-17", "see  NQ-17", "B#3"), ("B", 1, "person", "Ann", "q", "B#4"), ("A", 1, "name", "alone", "q", "A#4")],
    )
    nodes = spark.createDataFrame([("A", "room/Incident_Memo.v2.pdf", "room", "2025-01-10", ["draft"]), ("B", "Second_Agreement.pdf", "", None, []), ("X", "X.pdf", "", None, []), ("Y", "Y.pdf", "", None, [])], NODES)
    ranked = spark.createDataFrame([(1, d, k) for k, d in enumerate("AXBY", 1)], "matter int, doc string, place int")
    consequences = spark.createDataFrame([(1, "series-break", "B", "weekly", "2025-01-14", None, "B#6"), (1, "model-after", "X", None, "2025-02-01", "5", "X#3")], "matter int, kind string, doc string, series string, period string, figure string, anchor string")
    versions = spark.createDataFrame([(1, "A", "B")], "matter int, draft string, final string")
    clusters, seeds = spark.createDataFrame([(1, "A"), (1, "B")], SET), spark.createDataFrame([(1, "A")], SET)
    sections = spark.createDataFrame([("B", "B#7", "Dated 1 February 2025", 1)], SECTIONS)
    dated = spark.createDataFrame([("B", "2025-02-01", "B#7")], "doc string, day string, anchor string")
    lines = T.dossier_lines(clusters, seeds, ranked, consequences, versions, nodes, own, dated, sections)
    matters = spark.createDataFrame([(1, "A", "2025-01-10"), (2, "Z", None)], "matter int, seed string, date string")
    texts = {r["matter"]: r["text"] for r in T.markdown(lines, matters).collect()}
    assert texts[1] == WANTED.replace("$9m", "$9,000,000")
    assert texts[2].startswith("## Matter 2\n\nSeed Z. Date -.\n\n### Documents\n\n### Timeline\n")


@pytest.mark.parametrize("name", ["comparison_lines"])
def test_nothing_gives_nothing(spark, name):
    empty = spark.createDataFrame([], "matter int, row string, doc string, quote string, anchor string")
    assert getattr(T, name)(empty).count() == 0
