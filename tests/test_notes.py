import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import notes as N
from tessera.sources import records as S

SECTIONS = [("A", 1, "A#l1", "The  “pump” **failed** on"), ("A", 2, "A#l3", "Monday. It cost $1,200."), ("A", 3, "A#l5", "x | $5m | 30%"), ("B", 1, "B#l1", "Nothing")]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_quotes_are_located(spark):
    sections = spark.createDataFrame(SECTIONS, "doc string, ordinal int, anchor string, text string")
    quotes = spark.createDataFrame([("A", 0, 'The "pump" failed'), ("A", 1, "failed on Monday. It"), ("A", 2, "nowhere"), ("A", 3, " "), ("B", 4, "pump"), ("A", 5, "Monday. It cost $1,200. x"), ("A", 6, "on Monday. It cost $1,200. x")], "doc string, seq int, quote string")
    assert rows(N.located_in(quotes, sections), "seq", "anchor") == [(0, "A#l1"), (1, "A#l1"), (5, "A#l3")]
    items = spark.createDataFrame([("A", 0, "It cost $1,200.", "$1,200"), ("A", 1, "It cost $1,200.", "$9"), ("A", 2, "gone", "$1"), ("A", 3, "It cost $1,200.", "$1,200"), ("A", 4, "Monday.", None)], "doc string, seq int, quote string, surface string")
    kept, dropped = N.checked_items(items, sections, ["surface", "quote"])
    assert rows(kept, "seq", "surface", "anchor") == [(0, "$1,200", "A#l3")]
    assert rows(dropped, "seq", "reason") == [(1, "surface not inside the quote"), (2, "quote not found verbatim"), (4, "missing key surface")]
    assert rows(N.harvested(sections), "ordinal", "at", "surface", "quote") == [(2, 1, "$1,200", "It cost $1,200."), (3, 1, "$5m", "$5m"), (3, 2, "30%", "30%")]


def test_values_and_merging(spark):
    frame = spark.createDataFrame([(["DR-1", "x", "DR-1", None], "on **DR-1** and Plan", ["Plan", "DR-1", "no"])], "a array<string>, q string, n array<string>")
    assert frame.select(N.about_values(F.col("a"), F.col("q"), F.col("n"))).first()[0] == ["DR-1", "x", "Plan"][:1] + ["Plan"]
    named = spark.createDataFrame([("A", 0, "DR-1"), ("A", 1, "dr 1"), ("A", 2, "Plan"), ("B", 0, "z")], "doc string, seq int, value string")
    assert rows(N.uncovered(named, spark.createDataFrame([("A", "the plan stands")], "doc string, quote string")), "doc", "value") == [("A", "DR-1"), ("B", "z")]
    one, two = (spark.createDataFrame(x, "doc string, seq int, flag string, about array<string>") for x in ([("A", 0, "f", ["v"]), ("A", 1, "g", [])], [("A", 0, "f", ["v"]), ("A", 1, "f", [])]))
    assert rows(N.merged(one, two), "seq", "flag") == [(0, "f"), (1, "g"), (2, "f")]


def test_sections_are_cut(spark):
    text = "aaaa\nbb\ncccccccccccc\nd"
    got = rows(N.cut_sections(spark.createDataFrame([("A", 1, "x", text), ("A", 2, "y", "short"), ("A", 3, "z", "")], "doc string, ordinal int, anchor string, text string"), 8), "ordinal", "part", "text")
    assert got == [(1, 0, "aaaa\nbb"), (1, 1, "cccccccc"), (1, 2, "cccc\nd"), (2, 0, "short"), (3, 0, "")]


def test_replies(spark):
    texts = ['```json\n{"what": "a", "flags": []}\n```', '{"what": " ", "flags": []}', "[1]", "no", '{"what": "b"}']
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(N.reply_object(F.col("t"), S.NOTE).alias("r"))
    assert [r[0] for r in frame.select(N.well_shaped(F.col("r"))).collect()] == [True, False, False, False, False]
    log = spark.createDataFrame([("A", "dropped"), ("A", "re-asked"), ("B", "dropped")], "doc string, outcome string")
    docs = spark.createDataFrame([("A",), ("B",), ("C",)], "doc string")
    assert N.counts(docs.where("doc <> 'C'"), log, docs).first().asDict() == {"documents": 3, "noted": 2, "dropped": 2, "asked_again": 1}


def test_records_on_disk(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    note = {"doc": "a.pdf", "what": "w", "flags": [{"flag": "f", "quote": "q", "consequence": "c", "about": ["v"], "anchor": "a.pdf#l1"}], "figures": [], "cross_references": [{"kind": "code", "value": "x", "quote": "q", "anchor": "a"}], "concealed": []}
    (tmp_path / "notes/a.json").write_text(json.dumps(note, indent=1))
    (tmp_path / "notes/b.json").write_text(json.dumps(note | {"doc": "unknown.pdf"}))
    docs = spark.createDataFrame([("a.pdf", "D1")], "path string, doc string")
    got = S.read_notes(spark, f"file://{tmp_path}/notes", docs)
    assert rows(got["flags"], "doc", "seq", "flag") == [("D1", 0, "f")] and rows(got["cross_references"], "doc", "value") == [("D1", "x")] and got["concealed"].count() == 0
    (tmp_path / "map.json").write_text(json.dumps({"documents": [{"doc": "D1", "path": "a.pdf", "date": None}]}, indent=1))
    assert rows(S.read_mapping(spark, f"file://{tmp_path}/map.json"), "doc", "path") == [("D1", "a.pdf")]
    content = '{"doc": "D1", "text": "x"}\n\n{"doc": "D2", "text": "y"}\n'
    (tmp_path / "s.jsonl").write_text(content)
    pinned = lambda digest: S.read_pinned(spark, f"file://{tmp_path}/s.jsonl", digest, "doc string, text string")
    assert rows(pinned(hashlib.sha256(content.encode()).hexdigest()), "doc", "text") == [("D1", "x"), ("D2", "y")] == rows(S.read_jsonl(spark, f"file://{tmp_path}/s.jsonl", "doc string, text string"), "doc", "text")
    with pytest.raises(Exception, match="unexpected content"):
        pinned("0" * 64).count()
    records = spark.createDataFrame([("name", "b", ["z"]), ("date", "a", ["y", "x"]), ("name", "a", ["w"])], "kind string, value string, anchors array<string>")
    S.write_index(records, f"file://{tmp_path}/index")
    assert [json.loads(r[0])["anchors"][0] for r in spark.read.text(f"file://{tmp_path}/index").collect()] == ["y", "w", "z"]
    S.write_evidence(spark.createDataFrame([("P", "2025", 'a "b", c', "[A | A#l1]")], "document string, date string, quote string, citation string").coalesce(1), f"file://{tmp_path}/csv")
    assert b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("part*")) == b'\xef\xbb\xbfdocument,date,quote,citation\r\nP,2025,"a ""b"", c",[A | A#l1]\r\n'
    S.write_map(docs, spark.createDataFrame([("D1", "D2", "date", "v")], "a string, b string, kind string, value string"), f"file://{tmp_path}/map")
    S.write_documents(spark.createDataFrame([("d1", 2, "two"), ("d1", 1, "one"), ("d2", 1, "x")], "doc string, line int, text string"), f"file://{tmp_path}/room")
    assert "".join(p.read_text() for p in sorted((tmp_path / "room/doc=d1").glob("part*"))) == "one\ntwo\n" and spark.read.json(f"file://{tmp_path}/map/edges").count() == 1


def test_pieces_hold_no_section_that_is_longer(spark):
    from tessera.operators import notes, ranking
    from tests.test_links import rows

    sections = spark.createDataFrame([("A", 1, "a1", "x" * 10), ("A", 2, "a2", "y" * 45 + "\n" + "z" * 8), ("A", 3, "a3", "w" * 5), ("B", 1, "b1", "")], "doc string, ordinal int, anchor string, text string")
    assert rows(notes.split_sections(sections, 20), "doc", "piece", "first", "last", "n_sections", "chars") == [("A", 1, 1, 1, 1, 10), ("A", 2, 2, 2, 1, 20), ("A", 3, 2, 2, 1, 20), ("A", 4, 2, 3, 2, 20), ("B", 1, 1, 1, 1, 0)]
    held = spark.createDataFrame([(1, "revenue summary revenue"), (2, "harbor accounts")], "anchor int, text string")
    asks = spark.createDataFrame([(1, "revenue harbor summary", ["revenue", "summary"]), (2, "revenue harbor summary", [])], "ask int, text string, without array<string>")
    assert rows(ranking.closest_section(held, asks), "ask", "anchor", "shared") == [(1, 2, 1), (2, 1, 2)]
