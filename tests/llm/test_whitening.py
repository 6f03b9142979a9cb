"""Whitening by QDWH divide and conquer against numpy's symmetric eigensolver."""

import math

import numpy as np
import pytest

from seqrec.llm import queries, whitening

NAN, INF = float("nan"), float("inf")


def plain(x, k=4):
    """n, S, leading eigenvalues and vectors, trace of the distinct integer vectors."""
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = (n * u - s) / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    return n, s, e[::-1][:k], w[:, ::-1][:, :k], np.trace(v)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], "vec_id bigint, embedding array<double>, i int, part string, whitened double").repartition(3)


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T, q


@pytest.mark.parametrize("values", [
    [9.0, 4, 1, 0.25, 0.1], list(np.linspace(5, 1, 33)), [1.0, 1, 1, 1], [2.0, 1, 1, 1, 1, 1], [3.0, 3, 3, 1, 1, 0, 0, 0], [1e12, 1.0, 1e-6, 0.0], [1.0], [0.0, 0.0],
    [1 + 1e-9, 1.0, 1 - 1e-9, 0.5], list(2.0 ** -np.arange(40.0))])
def test_leading_components(values):
    a, _ = spectrum(values)
    a = (a + a.T) / 2
    e, v = whitening.leading(a, 4)
    k, size = min(4, len(values)), max(values) or 1.0
    want = np.linalg.eigvalsh(a)[::-1][:k]
    assert np.abs(e - want).max() <= 1e-13 * size * len(values)
    assert np.abs(v.T @ v - np.eye(k)).max() <= 1e-12
    assert np.abs(a @ v - v * e).max() <= 1e-12 * size * len(values)


def test_diagonal_matrices_whose_median_is_an_eigenvalue():
    for d in ([5.0, 3, 1], [2.0, 2, 1, 0, 0], [7.0, 1, 1, 1, 1, 1, 0.5]):
        e, v = whitening.leading(np.diag(d), 4)
        assert np.allclose(e, sorted(d)[::-1][:4], atol=1e-13)
        assert np.allclose(np.diag(d) @ v, v * e, atol=1e-12)


def test_polar_factor():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    e, v = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - (v * np.sign(e)) @ v.T).max() < 1e-12
    assert not whitening.polar(np.zeros((3, 3))).any()


def test_equals_eigensolver(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 24)) * np.linspace(2, 0.2, 24) + 5
    x = np.concatenate([x, x[:100], np.repeat(x[:1], 200, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = frame(spark, rows)
    model = whitening.fit(df)
    ints = np.floor(256 * x).astype(np.int64)
    n, s, e, w, trace = plain(ints)
    assert model["n"] == n and model["sums"] == s.tolist()
    assert np.allclose(model["eigenvalues"], e, rtol=1e-12) and abs(model["trace"] - trace) <= 1e-12 * trace
    assert model["identity_error"] < 1e-10
    got = {r["vec_id"]: r for r in whitening.whiten(df, model).collect()}
    sign = np.sign((model["components"] * w).sum(0))
    for i in range(len(x)):
        d = n * ints[i] - s
        assert int(got[i]["deviation"]) == sum(int(v) ** 2 for v in d)
        assert np.allclose(got[i]["whitened"], (d / n) @ w / np.sqrt(e) * sign, atol=1e-9)


def test_far_from_the_origin_and_beyond_longs(spark):
    """A mean that is large against the spread, and numbers whose products do not fit a long."""
    rng = np.random.default_rng(2)
    for offset in (1e6, 1e13):
        x = offset + rng.normal(size=(300, 5)) * [40, 30, 20, 10, 5]
        df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
        model = whitening.fit(df)
        ints = [[math.floor(256 * c) for c in v] for v in x.tolist()]
        n, s = len({tuple(v) for v in ints}), [sum(c) for c in zip(*{tuple(v) for v in ints})]
        assert model["n"] == n and model["sums"] == s and model["identity_error"] < 1e-9
        d = np.array([[float(n * c - t) / n for c, t in zip(v, s)] for v in ints])
        assert np.allclose(model["eigenvalues"], np.linalg.eigvalsh(d.T @ d / n)[::-1][:4], rtol=1e-10)
        got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df, model).collect()}
        assert got == {i: sum((n * c - t) ** 2 for c, t in zip(v, s)) for i, v in enumerate(ints)}


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [-0.001, 3.0, 0.5]), (3, None), (4, []), (5, [NAN, 1.0, 1.0]), (6, [1.0, INF, 0.0]), (7, [None, 1.0, 1.0]), (8, [1.0]),
            (None, [4.0, -0.0, 0.5]), (9, [0.0, 0.0, 0.5])]
    df = frame(spark, rows)
    model = whitening.fit(df)
    assert model["n"] == 4 and len(model["eigenvalues"]) == 2  # the third dimension is constant
    got = whitening.whiten(df, model).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in got) == [(False, 1), (False, 1), (False, 2), (False, 9), (True, None)]
    assert all(len(r["whitened"]) == 2 for r in got) and model["identity_error"] < 1e-12


def test_no_variance_and_no_rows(spark, tmp_path):
    constant = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    model = whitening.fit(constant)
    assert model["n"] == 1 and not len(model["eigenvalues"])
    assert [r["whitened"] for r in whitening.whiten(constant, model).collect()] == [[], []]
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).count() == 0
    for name, df in (("constant", constant), ("empty", empty)):
        df.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert queries.op13_whitening(spark, f"{tmp_path}/{name}").count() == 0


def test_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 10)).astype(np.float32)
    frame(spark, [(i, v.tolist()) for i, v in enumerate(x.astype(float))]).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries.op13_whitening(spark, str(tmp_path))
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = df.toPandas()
    n, s, e, w, trace = plain(np.floor(256 * x.astype(float)).astype(np.int64))
    assert len(got) == 1200 and set(got["component"]) == {1, 2, 3, 4} and got["identity_error"].max() <= 1e-4
    for k in range(4):
        mine = got[got["component"] == k + 1].sort_values("vec_id")
        assert np.allclose(mine["explained"], e[k] / trace, rtol=1e-10)
        want = (np.floor(256 * x.astype(float)) - s / n) @ w[:, k] / np.sqrt(e[k])
        assert min(np.abs(mine["whitened"] - want).max(), np.abs(mine["whitened"] + want).max()) < 1e-9
