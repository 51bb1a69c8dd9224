"""Whitening against a dense eigenvalue solver and plain Python integers."""

import numpy as np
import pytest

from photospark.llm import whitening

DDL = "vec_id bigint, embedding array<float>, x int, dim int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, 7, 7) for i, v in rows], DDL)


def brute(vectors, k=4):
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], x.shape[1])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, e, (x - sums / n) @ u / np.sqrt(e), e / np.trace(cov)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 12)) @ np.diag(np.linspace(1, 0.3, 12))
    return [(i, v) for i, v in enumerate(vectors.tolist())]


def test_equals_dense_solver(spark, rows):
    given = rows + [(i + 400, rows[i][1]) for i in range(150)]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(frame(spark, given).repartition(5)).collect()}
    n, deviation, e, white, explained = brute([v for _, v in given])
    assert n == 400 and len(got) == 4 * len(given)
    for c in range(4):
        own = np.array([got[i, c + 1]["whitened"] for i, _ in given])
        sign = np.sign(own @ white[:, c])
        assert np.allclose(own, sign * white[:, c], atol=1e-9)
        assert abs(got[0, c + 1]["explained"] - explained[c]) < 1e-12
    for i, _ in given:
        r = got[i, 1]
        assert (r["n"], r["deviation"], int(r["deviation_exact"])) == (400, deviation[i], deviation[i])
        assert r["identity_error"] < 1e-10


def test_solver_reaches_double_precision_on_clustered_values():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    values = np.concatenate([[100, 99.999, 50, 49.99, 49.98], np.linspace(49, 1, 55)])
    a = (q * values) @ q.T
    found, vectors = whitening.leading(lambda m: a @ m, 60, 4)
    assert np.allclose(found, values[:4], rtol=1e-13)
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() < 1e-11
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)


def test_solver_on_repeated_and_zero_values():
    a = np.diag([5.0] * 6 + [1.0] * 20)
    found, vectors = whitening.leading(lambda m: a @ m, 26, 4)
    assert np.allclose(found, 5) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    found, _ = whitening.leading(lambda m: 0 * m, 26, 4)
    assert np.allclose(found, 0)


def test_odd_rows(spark, rows):
    odd = [(900, None), (901, [float("nan")] * 12), (902, [None] + [0.0] * 11), (903, []), (904, [float("inf")] * 12), (None, rows[0][1]), (5, rows[1][1])]
    got = whitening.whiten(frame(spark, rows + odd)).collect()
    assert len(got) == 4 * (len(rows) + 2) and {r["n"] for r in got} == {400}
    assert sum(r["vec_id"] is None for r in got) == 4 and sum(r["vec_id"] == 5 for r in got) == 8


def test_lengths_apart_and_no_variance(spark):
    given = [(1, [0.5]), (2, [0.25]), (3, [0.5]), (4, [1.0, 2.0]), (5, [1.0, 2.0])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(frame(spark, given)).collect()}
    assert sorted(got) == [(1, 1), (2, 1), (3, 1), (4, 1), (4, 2), (5, 1), (5, 2)]
    assert (got[1, 1]["n"], got[4, 1]["n"]) == (2, 1) and abs(abs(got[2, 1]["whitened"]) - 1) < 1e-12
    assert got[4, 1]["whitened"] is None and got[4, 1]["explained"] is None and got[4, 1]["deviation"] == 0
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(8)
    vectors = (rng.normal(size=(50, 5)) * 1e12).tolist()
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")).collect()
    x = [[int(np.floor(256.0 * c)) for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in got:
        want = sum((50 * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert int(r["deviation_exact"]) == want and r["deviation"] is None
        assert r["identity_error"] < 1e-10
