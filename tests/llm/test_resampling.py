import hashlib
import math
import random
import re
import zlib

import pytest

from tessera.llm.resampling import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWERED))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target):
    s, t = [0] * 10000, [0] * 10000
    for _, text in docs:
        for b in features(text)[1]:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        n, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able[: len(able) * 5 // 100]):
        r[5] = k + 1
    return rows


def check(spark, docs, target):
    frame = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    got = [tuple(r) for r in resample(frame, goal).select("id", "n_words", "n_features", "weight", "score", "rank").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(map(tuple, brute(docs, target)), key=key)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["Word", "été", "x1", "ÀB", "日本語", "mid", "long" * 40, "A", "b2b", "zzz"]
    docs = [(k, rng.choice([" ", ", ", "-\n"]).join(rng.choice(vocabulary) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    docs += [(500, None), (501, ""), (502, "..."), (503, "one"), (504, "one two"), (None, "one two three " * 9), (7, "again " * 30), (7, "again " * 30), (505, "glued"), (506, "glued")]
    check(spark, docs, [docs[3][1], "Word1 mid2 x13", None, ""])


def test_very_long_texts_and_words(spark):
    rng = random.Random(5)
    docs = [(1, "w" * 3_000_000 + " tail"), (2, " ".join(f"t{rng.randint(0, 5000)}" for _ in range(200_000))), (3, "é" * 70_000 + " a " + "é" * 70_001)]
    check(spark, docs, ["tail t1 t2", "w" * 3_000_000])


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resample(docs, spark.createDataFrame([], "text string")).collect()
    assert [(r["id"], r["n_features"], r["weight"], r["rank"]) for r in got] == [(i, 0, 0, None) for i, _ in rows]


def test_query_equals_sql(spark):
    import duckdb

    from tessera.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    want = con.execute(SQL["op11_resample"]).fetchall()
    got = [tuple(r) for r in QUERIES["op11_resample"](spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == len(want) and {r[0]: r for r in got} == {r[0]: r for r in want}
