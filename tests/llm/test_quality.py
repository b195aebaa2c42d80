import random

from tessera.llm.quality import judge_quality


def room(rng, n):
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        kind = rng.random()
        toxic, bad = kind < 0.2, 0.2 <= kind < 0.4
        text = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if toxic:
            text += ["nasty", "vile"]
        if bad:
            text = [w + "###" for w in text]
        rows.append((k, " ".join(text), f"h{rng.randint(0, 3)}", rng.choice(["p", None]), 1))
        labels.append((k, int(not bad), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = room(random.Random(2), 600)
    rows += [(None, "word1 word2 word3", None, None, 1), (9000, None, "h0", "p", 1), (9001, "", "new", "p", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, keep int")
    seen = spark.createDataFrame(labels[:400] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["id"]: r for r in judge_quality(docs, seen).collect()}
    assert len(got) == len(rows)
    right = sum(got[k]["keep"] == bool(q and not t) for k, q, t in labels[400:])
    assert right >= 195
    assert all(0 <= r["p_quality"] <= 1 and 0 <= r["p_toxic"] <= 1 for r in got.values())


def test_sparse_sites_shrink(spark):
    rows, labels = room(random.Random(3), 300)
    docs = spark.createDataFrame([*rows, (7000, "word1 word2 " * 20, "tiny", "p", 1)], "doc_id long, text string, source string, lang string, n int")
    got = {r["id"]: r for r in judge_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    rates = [r["host_quality"] for k, r in got.items() if k != 7000]
    assert min(rates) - 0.2 < got[7000]["host_quality"] < 1 and got[7000]["host_quality"] < 0.99


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "h", "p")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["keep"] for r in judge_quality(docs, none).collect()] == [True]
    assert judge_quality(docs.limit(0), none).count() == 0


def test_labels_of_a_site_correct_what_its_texts_say(spark):
    rows, labels = room(random.Random(5), 300)
    plain = "word1 word2 word3 " * 10
    rows += [(1000 + k, plain, "worst" if k % 2 else "best", "p", 1) for k in range(200)]
    # Most labels fall outside the training sample; the last ten documents of each site have none.
    labels += [(1000 + k, 1 - k % 2, k % 2) for k in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n int")
    got = {r["id"]: r for r in judge_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), training_rows=150).collect()}
    assert got[1199]["host_quality"] < 0.3 < 0.7 < got[1198]["host_quality"]
    assert got[1199]["p_quality"] < got[1198]["p_quality"] and got[1199]["p_toxic"] > 4 * got[1198]["p_toxic"]
