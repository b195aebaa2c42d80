import random
import re

from tessera.llm import jaccard_join as J
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(rng):
    words = [f"w{k}é" if k % 9 == 0 else f"W{k}" for k in range(150)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = []
    for _ in range(25):
        texts.append([rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 30, 90]))] + (passage if rng.random() < 0.5 else []))
    for _ in range(90):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(t)
    return [(k, " ".join(t) if k % 3 else "\t".join(t).upper().replace("É", "é")) for k, t in enumerate(texts)]


def check(spark, rows, n, percent):
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    members, links = J.jaccard_join(frame, n_words=n, percent=percent)
    assert {r["id"]: (r["n"], r["component"]) for r in members.collect()} == brute(rows, n, percent)
    return links


def test_against_all_pairs(spark):
    rows = corpus(random.Random(8)) + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE")]
    check(spark, rows, 4, 85)
    check(spark, rows, 5, 80).count()


def test_long_lists_are_refined(spark, monkeypatch):
    for name, value in (("SHORT_LIST", 2), ("STARS", 1), ("LONG_LIST", 1)):
        monkeypatch.setattr(J, name, value)
    monkeypatch.setattr(J, "FREQUENT", 10**9)
    check(spark, corpus(random.Random(9)), 3, 80)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_join(empty)[0].count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((str(r["id"]), r["n"], str(r["component"])) for r in J.jaccard_join(odd)[0].collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 0, "2"), ("None", 2, "None")]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
