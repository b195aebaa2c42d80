import random
import re

from tessera.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    out = {}
    patterns = [(i, tuple(w[s : s + window])) for i, t in items if i is not None for w in [words(t)] for s in range(max(len(w) - window, 0) + 1) if w]
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, p in patterns:
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s : s + len(p)]) == p:
                    hit.update(range(s, s + len(p)))
                    found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["a", "B", "c1", "é", "Über", "dd", "x", "yy", "ÉÉ", "0"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 9, 14])))) for k in range(12)] + [(50, None), (None, "a B c1"), (3, "x x x x x")]
    docs = []
    for k in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if k % 2:
            own += words(rng.choice(items)[1])
        docs.append((k, rng.choice([" ", ", ", "-", "\n"]).join(own)))
    docs += [(99, None), (98, "")]
    for block in (200_000, 7):
        monkeypatch.setattr(D, "BLOCK_WINDOWS", block)
        for window in (4, 1):
            d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_words int")
            b = spark.createDataFrame(items, "item_id long, text string")
            got = {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in D.decontaminate(d, b, window=window).collect()}
            assert got == brute(docs, items, window)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in D.decontaminate(docs, none).collect()] == [(2, 0, [])]
    assert D.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
