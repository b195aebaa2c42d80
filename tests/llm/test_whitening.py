import numpy as np
import pytest

from tessera.llm.whitening import fit, whiten

SCHEMA = "vec_id long, embedding array<float>, deviation string"


def frame(spark, rows, n=3):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(n)


def integers(vectors):
    return [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    shape = rng.standard_normal((12, 12))
    rows = [(k, (rng.standard_normal(12) @ shape).astype(np.float32).tolist()) for k in range(300)]
    rows += [(3, rows[3][1]), (None, rows[5][1])]
    bad = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] + [1.0] * 11), (904, [float("inf")] * 12), (905, [1.0] * 5)]
    table = frame(spark, rows + bad)
    model = fit(table, components=8)
    x = integers(v for _, v in rows)
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    assert model.n == n and model.sums == sums
    centred = np.array(x) - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert np.allclose(model.explained, values[:8] / values.sum(), rtol=1e-9)
    assert model.identity_error < 1e-8
    got = sorted(((r["id"] is None, r["id"] or 0, r["deviation"], r["whitened"]) for r in whiten(table, model).collect()), key=lambda r: r[:3])
    want = sorted((i is None, i or 0, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), k) for k, ((i, _), v) in enumerate(zip(rows, x, strict=True)))
    assert [r[:3] for r in got] == [w[:3] for w in want]
    expected = centred[[w[3] for w in want]] @ axes[:, :8] / np.sqrt(values[:8])
    actual = np.array([r[3] for r in got])
    signs = np.sign((actual * expected).sum(axis=0))
    assert np.allclose(actual, expected * signs, atol=1e-8)


def test_same_whatever_the_partitions(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.standard_normal(6).tolist()) for k in range(80)]
    a, b = (fit(frame(spark, rows, n)) for n in (1, 7))
    assert a.sums == b.sums and np.allclose(a.axes, b.axes, atol=1e-9) and len(a.values) == 6


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_no_usable_vector(spark, rows):
    table = frame(spark, rows, 1)
    assert fit(table) is None
    assert whiten(table, None).count() == 0


def test_one_vector_or_copies_have_no_variance(spark):
    table = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    model = fit(table)
    assert [(r["deviation"], r["whitened"]) for r in whiten(table, model).collect()] == [(0, [None, None])] * 2
    assert model.identity_error == 0.0 and model.explained.tolist() == [0.0, 0.0]


def test_huge_entries_and_deviations_beyond_a_long(spark):
    table = frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 1.0])])
    got = {r["id"]: r["deviation"] for r in whiten(table, fit(table)).collect()}
    assert got[1] is None and got[2] is None and got[3] is not None
