import numpy as np
import pytest

from tessera.llm import neighbours as N


def exact(rows, asked, k):
    usable = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    width = max((len(v) for v in usable.values()), default=0)
    usable = {i: np.pad(v, (0, width - len(v))) for i, v in usable.items()}
    return {q: sorted(((-float(np.dot(usable[q], v)), i) for i, v in usable.items() if i != q))[:k] for q in asked if q in usable}


@pytest.mark.parametrize("n", [15, 1500])
def test_recall(spark, n):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.standard_normal(12) * rng.uniform(0.5, 2)).round(3).tolist()) for k in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(5)]
    rows += [(9000, None), (9020, [0.0] * 12), (9040, [float("nan")] + [1.0] * 11), (9060, [None] + [1.0] * 11), (9080, []), (9100, [float("inf")] * 12), (None, [1.0] * 12)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got: dict = {}
    for r in N.nearest(frame, frame.where("vec_id % 20 = 0"), k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(rows, range(0, 9101, 20), 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:], strict=False))
    # The largest vector's copies are nearer to it than any other vector.
    usable = {i: v for i, v in rows[:n]}
    assert all(abs(s - float(np.dot(usable[q], usable[i]))) < 1e-9 for q in got if q < n for _, i, s in got[q] if i < n)


def test_no_usable_vectors(spark):
    frame = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert N.nearest(frame, frame).count() == 0
