from __future__ import annotations

import math

import numpy as np
import pytest

from tallybook.llm import whitening
from tallybook.llm.queries import op12_whitening

SF = "/root/testdata/sf0.001"


def symmetric(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * np.array(values)) @ q.T


MATRICES = [
    np.diag([3.0, 1.0, 2.0]),
    np.diag([1.0, 1.0, 1.0]),
    np.zeros((4, 4)),
    np.array([[2.5]]),
    symmetric([5, 4, 3, 2, 1]),
    symmetric([5, 5, 5, 1, 1, 1]),  # repeated eigenvalues
    symmetric([1e6, 1, 1e-6, 1e-9, 0, 0]),
    symmetric([1, 1 + 1e-9, 1 + 2e-9, 7]),  # close ones
    symmetric([-3, -1, 0, 0, 2, 9]),
    symmetric(np.random.default_rng(2).exponential(size=64)),
    symmetric(np.geomspace(1, 1e-8, 40)),
    np.ones((30, 30)),
    np.kron(np.eye(3), np.array([[0, 1.0], [1.0, 0]])),
]


@pytest.mark.parametrize("a", MATRICES)
def test_eigenvectors_as_the_library(a):
    values, vectors = whitening.eigen(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13 * size * len(a))
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13 * len(a)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size * math.sqrt(len(a))


def test_polar_factor_is_orthogonal_and_leaves_a_positive_rest():
    a = symmetric([4, 1, 1e-7, -1e-3, -2])
    u = whitening.polar_factor(a)
    assert np.abs(u @ u - np.eye(5)).max() < 1e-12
    assert np.linalg.eigvalsh(u @ a).min() > 0


def brute(rows):
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    far = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    return n, far, values, centred @ vectors / np.sqrt(np.maximum(values, 1e-300))


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, far, values, white = brute(rows)
    got = {}
    for r in op12_whitening(spark, SF).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert got.keys() == {i for i, _ in rows}
    signs = np.ones(32)
    for k in range(32):
        signs[k] = np.sign(got[rows[0][0]][k + 1]["whitened"] * white[0, k])
    for j, (i, _) in enumerate(rows):
        assert sorted(got[i]) == list(range(1, 33))
        for k, r in got[i].items():
            assert (r["n"], r["deviation"]) == (n, far[j])
            assert r["whitened"] == pytest.approx(signs[k - 1] * white[j, k - 1], abs=1e-9)
            assert r["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-12)
            assert 0 <= r["identity_error"] < 1e-10


def whitened(spark, rows, schema="vec_id long, embedding array<double>"):
    grid = whitening.on_grid(spark.createDataFrame(rows, schema))
    fitted = whitening.fit(grid)
    return fitted, whitening.whiten(grid, fitted).collect(), whitening.identity_error(grid, fitted)


def test_rows_that_take_no_part_and_repeated_ones(spark):
    good = [(1, [0.1, 0.9]), (1, [0.1, 0.9]), (None, [-0.5, 0.2]), (4, [0.7, 0.7]), (5, [3.0, -8.0])]
    bad = [(6, None), (7, []), (8, [1.0, None]), (9, [1.0, math.nan]), (10, [math.inf, 0.0]), (11, [1.0, 2.0, 3.0]), (12, [1e300, 0.0])]
    fitted, rows, error = whitened(spark, good + bad)
    n, far, _, white = brute(good)
    assert fitted.n == n == 5 and error < 1e-12
    assert sorted((r["_row"]["vec_id"] or 0, r["_deviation"]) for r in rows) == sorted((i or 0, f) for (i, _), f in zip(good, far, strict=True))
    assert np.allclose(sorted(abs(r["_whitened"][0]) for r in rows), sorted(abs(white[:, 0])))


def test_far_entries_stay_exact(spark):
    good = [(i, [2.0**31 + i / 64, -(2.0**31), float(i)]) for i in range(6)]
    fitted, rows, _ = whitened(spark, good)
    _, far, _, _ = brute(good)
    assert sorted(r["_deviation"] for r in rows) == sorted(far)
    assert len(fitted.values) == 1  # all vary along one line
    # 6 x (2^38)^2 x 36 passes a long
    _, rows, _ = whitened(spark, [(i, [2.0**32 * (i % 2)]) for i in range(6)])
    assert {r["_deviation"] for r in rows} == {None}


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 9, [(1, None), (2, [])]):
        fitted, out, error = whitened(spark, rows)
        assert (len(fitted.values), out, error) == (0, [], 0.0)


def test_clashing_columns_ride_along(spark):
    rows = [(i, [0.1 * i, (i * i % 5) / 5], "a", i) for i in range(12)]
    _, out, _ = whitened(spark, rows, "_x long, embedding array<float>, _whitened string, n long")
    assert sorted((r["_row"]["_x"], r["_row"]["_whitened"], r["_row"]["n"]) for r in out) == [(i, "a", i) for i in range(12)]
