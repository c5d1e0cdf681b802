"""Whitening against eigenvectors of the exact covariance."""

from fractions import Fraction

import numpy as np
import pytest

from wardline.llm import whitening

FIELDS = "vec_id long, embedding array<double>"


def covariance(vectors):
    """n, exact deviations, and the covariance with every entry rounded once."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64).astype(object) + 100_000
    n, s = len(x), x.sum(0)
    y = n * x - s
    v = np.array([[float(Fraction(int(a), n**3)) for a in row] for row in y.T @ y])
    return n, (y**2).sum(1), v, y.astype(float) / n


def check(spark, vectors, held, components=8, extra=()):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*rows, *extra], FIELDS).repartition(5)
    got = sorted(whitening.whiten(df, ["vec_id"], "embedding", components).collect(), key=lambda r: (r["vec_id"], r["component"]))
    n, deviation, v, centred = covariance([r[1] for r in rows])
    assert len(got) == n * held
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, k + 1) for i in range(n) for k in range(held)]
    assert all(r["n"] == n and r["deviation"] == (d if (d := deviation[r["vec_id"]]) < 1 << 63 else None) for r in got)
    white = np.array([r["whitened"] for r in got]).reshape(n, held)
    error = abs(np.cov(white.T, bias=True).reshape(held, held) - np.eye(held)).max()
    assert error < 1e-8 and {r["identity_error"] for r in got} == {got[0]["identity_error"]}
    assert abs(got[0]["identity_error"] - error) < 1e-12
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:held], u[:, ::-1][:, :held]
    share = np.array([r["explained"] for r in got[:held]])
    return white, centred, e, u, share, np.trace(v)


@pytest.mark.parametrize("dims", [3, 20])
def test_equal_to_eigenvectors(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = (rng.normal(size=(400, dims)) @ rng.normal(size=(dims, dims))).tolist()
    vectors += vectors[:30]
    odd = [(900, None), (901, [1.0] * (dims - 1)), (902, [None] + [1.0] * (dims - 1)), (903, [float("nan")] * dims), (904, [float("-inf")] * dims), (905, [])]
    held = min(8, dims)
    white, centred, e, u, share, trace = check(spark, vectors, held, extra=odd)
    want = centred @ u / np.sqrt(e)
    want *= np.sign((want * white).sum(0))
    assert abs(want - white).max() < 1e-9
    assert abs(share / (e / trace) - 1).max() < 1e-12


def test_close_and_tiny_variances(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(500, 6)) * [1e7, 1e7, 1e5, 40, 1, 1 / 8]
    mixed = np.stack([base[:, 0], base[:, 0] + base[:, 3], base[:, 1], base[:, 1] + base[:, 4], base[:, 2], base[:, 5]], 1)
    white, _, e, _, share, trace = check(spark, mixed.tolist(), 6)
    assert share[0] > 0.5 and share[-1] < 1e-15


def test_missing_directions(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(60, 3))
    whole = np.floor(a * 500) / 1024
    # a constant, a repeated and a summed dimension
    vectors = np.stack([whole[:, 0], np.full(60, 3.0), whole[:, 1], whole[:, 0], whole[:, 0] + whole[:, 1], whole[:, 2]], 1)
    white, centred, e, u, share, trace = check(spark, vectors.tolist(), 3)
    want = centred @ u / np.sqrt(e)
    want *= np.sign((want * white).sum(0))
    assert abs(want - white).max() < 1e-8
    # fewer rows than dimensions
    check(spark, rng.normal(size=(5, 12)).tolist(), 4)
    check(spark, rng.normal(size=(2, 12)).tolist(), 1)


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], FIELDS)
    assert whitening.report(same).collect() == []
    assert whitening.report(same.limit(1)).collect() == []
    assert whitening.report(same.filter("false")).collect() == []
    assert whitening.report(spark.createDataFrame([(1, None), (2, [])], FIELDS)).collect() == []


def test_keys_extra_columns_and_large_sums(spark):
    rows = [(None, [float(i % 3), float(i)], i) for i in range(5)] + [(7, [2.0**45, 5.0], 9)]
    df = spark.createDataFrame(rows, FIELDS + ", n long")
    got = whitening.report(df).collect()
    assert len(got) == 12 and sum(r["vec_id"] is None for r in got) == 10 and {r["n"] for r in got} == {6}
    assert {r["deviation"] is None for r in got} == {True}
    x = np.array([[0, 0], [3, -7], [2**31 + 1, 2], [2**30, 2**30]], np.int64)
    got = whitening.deviations(x, np.array([0, 1], np.int64), np.array([1, 0], np.int64), 2).to_pylist()
    want = [sum((2 * (int(c) - m) - r) ** 2 for c, m, r in zip(row, (0, 1), (1, 0))) for row in x]
    assert got == [w if w < 1 << 63 else None for w in want]


def test_whole_small_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = sorted(whitening.report(rows).collect(), key=lambda r: (r["vec_id"], r["component"]))
    table = sorted(rows.collect(), key=lambda r: r["vec_id"])
    n, deviation, v, centred = covariance([r["embedding"] for r in table])
    e, u = np.linalg.eigh(v)
    want = (centred @ u / np.sqrt(e))[:, ::-1][:, :8]
    white = np.array([r["whitened"] for r in got]).reshape(-1, 8)
    want *= np.sign((want * white).sum(0))
    assert abs(want - white).max() < 1e-8 and [r["deviation"] for r in got[::8]] == deviation.tolist()
    assert abs(np.array([r["explained"] for r in got[:8]]) / (e[::-1][:8] / e.sum()) - 1).max() < 1e-10
