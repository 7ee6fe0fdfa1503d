"""Spectrum slicing against a dense solver, and whitening against plain arithmetic."""

import math

import numpy as np
import pytest

from larkfield.llm import spectrum, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [
    np.arange(1, 41.0), 2.0 ** -np.arange(30), np.r_[5, 5, 5, 3, 2, 2, 1.0, 0.5], np.r_[1 + 1e-9, 1.0, 0.5, 0.25, 0.0, 0.0],
    np.ones(6), np.r_[1e9, 1.0, 1e-2, 0.0], np.r_[3.0]])
def test_slicing_finds_the_leading_pairs(values):
    values = np.sort(values)[::-1]
    matrix = symmetric(values, 3)
    got, vectors = spectrum.leading_eigenpairs(matrix, 8)
    want = values[values > 1e-12 * values.sum()][:8]
    assert len(got) == len(want) and np.allclose(got, want, rtol=0, atol=1e-12 * values[0] * len(values))
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-10
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-12 * values[0] * len(values)


def test_counts_are_those_of_the_spectrum():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 10, 33):
        m = rng.standard_normal((d, d))
        m = m + m.T
        values = np.linalg.eigvalsh(m)
        for shift in [*(values + 1e-6), *(values - 1e-6), 0.0]:
            assert spectrum.count_above(m, shift) == (values > shift).sum()
    zero_diagonal = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert spectrum.count_above(zero_diagonal, 0.0) == 1


def brute(rows, components):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    y = (n * x - s).astype(float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return kept, n, deviation, values, y @ (vectors / np.sqrt(values)), values / np.trace(y.T @ y / n)


@pytest.mark.parametrize("parts", [1, 40])
def test_whitened_rows_equal_plain_arithmetic(spark, parts):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((300, 12)) * np.linspace(3, 0.5, 12) + 40
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (5, rows[5][1])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).selectExpr("*", "1 AS x", "2 AS n", "3 AS part").repartition(parts)
    kept, n, deviation, values, whitened, explained = brute(rows, 5)
    got = {}
    for r in whitening.whiten(frame, components=5).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == 5 * 300 and sum(map(len, got.values())) == 5 * len(kept) and n == 301
    signs = {}
    for (i, _), dev, w in zip(kept, deviation, whitened):
        for k in range(5):
            for r in got[i, k + 1]:
                assert r.n == n and r.deviation == dev and abs(r.explained - explained[k]) < 1e-12 and 0 <= r.identity_error < 1e-9
                sign = signs.setdefault(k, 1.0 if abs(r.whitened - w[k]) < abs(r.whitened + w[k]) else -1.0)
                assert abs(sign * r.whitened - w[k]) < 1e-9


def test_lengths_are_fitted_apart_and_flat_directions_have_no_component(spark):
    rows = [(i, [float(i % 7), float(i % 3)], 0) for i in range(40)] + [(100 + i, [float(i), 2.0, 1.0], 0) for i in range(20)] + [(None, [9.0], 1)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r.vec_id < 100, r.component, r.n) for r in got} == {(True, 1, 40), (True, 2, 40), (False, 1, 20)}
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, VECTORS)).collect() == []


def test_squared_deviations_beyond_64_bits_are_null(spark):
    big = float(2**40)
    rows = [(1, [big, 0.0], 0), (2, [0.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, [0.0, -1.0], 0)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got[1] is None and set(got) == {1, 2, 3, 4}
