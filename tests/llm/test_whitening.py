"""Whitening against a brute-force version in exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import whitening


def grid(vec):
    if not vec or any(c is None or not math.isfinite(c) for c in vec):
        return None
    x = tuple(math.floor(256 * Fraction(c)) for c in vec)
    return x if all(abs(256 * c) < 2.0**62 for c in vec) else None


def check(found, rows, components=4):
    """Exact columns by fractions, inexact ones by what they must do."""
    kept = [(i, x) for i, v in rows if (x := grid(v)) is not None]
    lengths = [len(x) for _, x in kept]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n))
    kept = [(i, x) for i, x in kept if len(x) == dims]
    fitted = sorted({x for _, x in kept})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    v = [[sum(Fraction(x[d] * n - sums[d], n) * Fraction(x[e] * n - sums[e], n) for x in fitted) / n for e in range(dims)] for d in range(dims)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in v]))
    trace, size = float(sum(v[d][d] for d in range(dims))), min(components, dims)
    values, vectors = values[::-1][:size], vectors[:, ::-1][:, :size]
    assert len(found) == len(kept) * size
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
        assert r.n == n and abs(r.explained - values[r.component - 1] / trace) <= 1e-9 * r.explained and 0 <= r.identity_error <= 1e-9
    want = {}
    for i, x in kept:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        want.setdefault((i, dev if dev < 2**63 else None), []).append(x)
    assert set(by) == set(want)
    signs = {}
    for key, xs in want.items():
        for k in range(size):
            got = sorted(r.whitened for r in by[key][k + 1])
            mine = sorted(float(sum(vectors[d, k] * float(Fraction(n * x[d] - sums[d], n)) for d in range(dims)) / math.sqrt(values[k])) for x in xs)
            fits = [s for s in (1, -1) if np.allclose(got, sorted(s * m for m in mine), rtol=1e-6, atol=1e-7)]
            assert fits, (key, k)
            if len(fits) == 1:
                signs.setdefault(k, fits[0])
                assert signs[k] == fits[0]


def test_query_on_the_small_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").limit(60).collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(whitening.whiten(df).collect(), rows)
    found = whitening.query(spark, small)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = spark.read.parquet(f"{small}/embeddings.parquet").count()
    assert found.count() == 4 * table and found.agg(F.max("identity_error")).first()[0] <= 1e-9


@pytest.fixture(scope="module")
def messy_rows():
    rng = np.random.default_rng(8)
    nan, inf = float("nan"), float("inf")
    plain = [(n, [float(c) for c in rng.normal(0, 0.2, 5) * [5, 4, 3, 2, 1]]) for n in range(200)]
    odd = [(1, None), (None, None), (None, [0.1] * 5), (2, [nan] * 5), (3, [1.0, inf, 0.0, 0.0, 0.0]), (4, [None, 1.0, 1.0, 1.0, 1.0]), (5, []), (6, [1.0, 2.0]), (7, [1e300, 0.0, 0.0, 0.0, 0.0])]
    return plain + odd + plain[:30] + [(900 + n, [0.1, -0.0, 0.0, -1e-9, 0.003]) for n in range(150)]


def test_messy_rows(spark, messy_rows):
    df = spark.createDataFrame(messy_rows, "vec_id long, embedding array<double>").withColumns({n: F.lit("clash") for n in ["id", "x", "place", "n", "component", "odd name-1"]})
    check(whitening.whiten(df.repartition(7)).collect(), messy_rows)


def test_large_values_stay_exact(spark):
    """Grid values of 2 ** 40 and 2 ** 58: squares far beyond a long."""
    for top in (2.0**32, 2.0**50):
        rng = np.random.default_rng(4)
        rows = [(n, [float(c) for c in rng.uniform(-top, top, 3)]) for n in range(80)]
        check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=4).collect(), rows)


def test_tables_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(n, [0.5, 0.25]) for n in range(5)]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).collect() == []
    flat = [(n, [float(n), 1.0, 2.0 * n]) for n in range(6)]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(flat, kind)).collect()} == {1}


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 62), st.integers(1, 5), st.integers(1, 40), st.integers(0, 2**31))
def test_sums_of_squares(bits, dims, rows, seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(-(1 << bits) + 1, 1 << bits, (rows, dims))
    assert whitening.square_sums(s) == [sum(int(c) ** 2 for c in s[:, d]) for d in range(dims)]


def test_covariance_comes_from_pair_sums():
    z = np.array([[3, -1, 4], [-2, 5, 0], [-1, -4, -4]])
    squares = whitening.polarised(z)
    assert squares == [14, 42, 32, 38, 78, 98]
    v, trace = whitening.covariance(3, 3, squares)
    assert np.array_equal(v, (z.T @ z) / 27) and trace == 88 / 27
