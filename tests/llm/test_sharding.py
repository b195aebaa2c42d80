from collections import Counter

from tessera.llm.sharding import _fisher_yates, shuffle_into_shards


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(_fisher_yates(3, [1, k])) for k in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())
    assert len(_fisher_yates(0, [1])) == 0


def test_shards(spark, tmp_path):
    rows = [(k if k % 7 else None, None if k % 5 == 0 else "x" * (k % 30), 1) for k in range(203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    once = shuffle_into_shards(docs, f"{tmp_path}/a", bucket_bytes=300).collect()
    again = shuffle_into_shards(docs.repartition(5), f"{tmp_path}/b", bucket_bytes=300).collect()
    key = lambda r: (r["shard"], r["slot"])
    assert sorted(once, key=key) == sorted(again, key=key)
    assert sorted(((r["id"], r["text"]) for r in once), key=str) == sorted(((a, b) for a, b, _ in rows), key=str)
    sizes = Counter(r["shard"] for r in once)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all({r["slot"] for r in once if r["shard"] == s} == set(range(n)) for s, n in sizes.items())
    assert [r["id"] for r in sorted(once, key=key)] != sorted((a for a, _, _ in rows), key=str)
    assert shuffle_into_shards(docs.limit(0), f"{tmp_path}/c").count() == 0


def test_many_rows_alike_are_dealt_to_several_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.llm.sharding.MANY_ALIKE", 20)
    monkeypatch.setattr("tessera.llm.sharding._GROUP", 2)
    rows = [(None, "x")] * 300 + [(k, "long text " * 40) for k in range(30)]
    got = shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), f"{tmp_path}/a", shards=3, bucket_bytes=1500).collect()
    assert sorted(((r["id"], r["text"]) for r in got), key=str) == sorted(rows, key=str)
    sizes = Counter(r["shard"] for r in got)
    assert sizes == {0: 110, 1: 110, 2: 110}
    assert all({r["slot"] for r in got if r["shard"] == s} == set(range(110)) for s in sizes)
    # The ones alike are spread: no shard is full of them.
    assert all(sum(1 for r in got if r["shard"] == s and r["id"] is None) > 60 for s in sizes)
