import random

from tessera.operators import contained, verify


def test_strings_are_held_as_brute_force_says(spark, monkeypatch):
    monkeypatch.setattr(contained, "PIECE", 16)
    draw = random.Random(5)
    texts = {room: "".join(draw.choice("aab  b\n1é") for _ in range(300)) for room in "xy"} | {"n": None, "e": ""}
    sought = [(room, texts[draw.choice("xy")][(at := draw.randrange(300)) : at + draw.randrange(25)]) for room in "xyne" * 60]
    sought += [("x", "a" * 12), ("x", "zzz zzz"), ("z", "a"), ("x", ""), ("n", ""), ("e", "")]
    got = contained.held(spark.createDataFrame(sought, "room string, quote string"), spark.createDataFrame(list(texts.items()), "room string, text string"))
    want = {(room, q) for room, q in sought if texts.get(room) is not None and q in texts[room]}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_long_text_is_cut_and_read_once(spark):
    said = "\n".join(f"ORD-{k} late" for k in range(20_000))
    rows = spark.range(40_000).selectExpr("'x' as room", "concat('ORD-', id, ' late') as quote")
    assert contained.held(rows, spark.createDataFrame([("x", said.replace("\n", " "))], "room string, text string")).count() == 20_000


def test_an_anchor_is_not_another_ones_beginning(spark):
    findings = spark.createDataFrame([(7, "C1.md#l7", "Harbor pump cost $157,000"), (78, "C1.md#l78", "Harbor pump cost $157,000")], "id int, anchor string, finding string")
    said = spark.createDataFrame([("Harbor pump cost 157000 [C1 | C1.md#l78].",)], "text string")
    assert [r["id"] for r in verify.uncarried(findings, said).collect()] == [7]
