import random
import zlib

import pytest

from tessera.llm.toxicity import DRIFT, maximal_segments, score_toxicity


def all_maximal(scores):
    """Maximal segments by their definition: best segment, then the same left and right of it."""
    if not scores:
        return []
    best = max(((sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), key=lambda x: (round(x[0], 9), -(x[2] - x[1])))
    total, a, b = best
    if total <= 1e-9:
        return []
    return all_maximal(scores[:a]) + [(a, b - 1, total)] + [(x + b, y + b, s) for x, y, s in all_maximal(scores[b:])]


@pytest.mark.parametrize("seed", range(40))
def test_segments_equal_the_definition(seed):
    rng = random.Random(seed)
    n = rng.randint(0, 60)
    places = sorted(rng.sample(range(n), rng.randint(0, n // 2))) if n else []
    scores = [rng.choice([0.05, 0.3, 0.7, 1.9]) + rng.random() / 7 for _ in places]
    dense = [-DRIFT] * n
    for p, s in zip(places, scores, strict=True):
        dense[p] += s
    got = sorted((a, b, round(s, 6)) for a, b, s in maximal_segments(places, scores))
    assert got == sorted((a, b, round(s, 6)) for a, b, s in all_maximal(dense))


def corpus(rng, n, mean=0.2):
    plain = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(400)]
    rows = []
    for k in range(n):
        text = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        toxic = rng.random() < mean
        if toxic:
            at = rng.randint(0, len(text))
            words = ["vile", "nasty", *(f"grimm{rng.randint(0, 9999)}" for _ in range(2))]
            text[at:at] = [w for _ in range(3) for w in (rng.choice(words), rng.choice(plain))]
        rows.append((k, " ".join(text), int(toxic)))
    return rows


def frames(spark, rows, labelled):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, score string, toxic int").repartition(3)
    return docs, spark.createDataFrame(labelled, "doc_id long, toxic int")


def test_held_out_documents_and_passages(spark):
    rows = corpus(random.Random(4), 900)
    training = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5]
    extra = [(5000, None, 0), (5001, "", 0), (5002, "...", 0), (None, "worda", 0), (7, rows[7][1], rows[7][2]), (5003, "Ünïcödé wordaax " * 3 + "grimm77 VILE nasty", 1)]
    docs, labels = frames(spark, rows + extra, [*training, (None, 1), (3, None), (999999, 1)])
    got = {r["id"]: r for r in score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows) + 5
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i]["score"] >= 0.5) == bool(y) for i, y in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[5000]["score"] == got[5001]["score"] == got[5002]["score"] < 0.5 and got[5000]["passages"] == []
    found = got[5003]["passages"]
    text = extra[-1][1].encode()
    assert [text[p["begin"] : p["end"]].decode() for p in found] == ["grimm77 VILE nasty"] and got[5003]["score"] > 0.5
    # Passages of clean documents are as rare as their expected number says.
    assert sum(len(got[i]["passages"]) for i, _, y in rows if not y) <= 0.05 * len(rows)


def test_very_long_text(spark):
    rows = corpus(random.Random(6), 400)
    plain = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 15)}x" for k in range(400_000))
    rows += [(7000, plain, 0), (7001, plain[:1_600_000] + "vile nasty vile nasty vile nasty " + plain[:900_000], 1), (7002, "z" * 2_000_000, 0)]
    docs, labels = frames(spark, rows, [(i, y) for i, _, y in rows if i < 7000])
    got = {r["id"]: r for r in score_toxicity(docs, labels).where("id >= 7000").collect()}
    assert got[7000]["score"] < 0.5 and got[7002]["score"] < 0.5 and got[7001]["score"] > 0.5
    assert [(p["begin"], p["end"]) for p in got[7001]["passages"]] == [(1_600_000, 1_600_032)]


@pytest.mark.parametrize("labelled", [[], [(1, 0), (2, 0)]])
def test_no_labels_or_one_label(spark, labelled):
    docs, labels = frames(spark, [(1, "a b", 0), (2, None, 0)], labelled)
    scores = {r["score"] for r in score_toxicity(docs, labels).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_training_rows_are_bounded_and_scores_do_not_depend_on_partitions(spark):
    rows = corpus(random.Random(8), 300)
    docs, labels = frames(spark, rows, [(i, y) for i, _, y in rows])
    a = {r["id"]: r["score"] for r in score_toxicity(docs.repartition(5), labels, training_rows=200).collect()}
    b = {r["id"]: r["score"] for r in score_toxicity(docs.coalesce(1), labels, training_rows=200).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
