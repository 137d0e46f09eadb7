"""Sums that are the same in any order, and the nearest doubles."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmat.operators import algebra, exact_kernels
from gridmat.operators.exact_sum import exact_sum, with_digits
from gridmat.operators.sparse_product import matmul_ipb_sparse, matmul_naive_sparse, matmul_opb_sparse
from helpers import cells_of

INF = float("inf")


def _groups(seed=0):
    rng = np.random.default_rng(seed)
    yield [0.1] * 10
    yield [1e16, 1.0, -1e16]
    yield [1.0, 2.0**-53, 2.0**-106]
    yield [1.0, 2.0**-53]
    yield [1.0 + 2.0**-52, 2.0**-53, -(2.0**-120)]
    yield [1e308, 1e308, -1e308]
    yield [5e-324, 5e-324, 2.0**-1022, -(2.0**-1030)]
    yield [0.0, -0.0]
    yield [2.0**26, 2.0**-26, -(2.0**52), 2.0**78 - 2.0**30]
    yield [-3.5, 3.5]
    for _ in range(60):
        n = int(rng.integers(1, 60))
        x = rng.standard_normal(n) * 2.0 ** rng.integers(-300, 300, n)
        yield x.tolist()
        yield [*x.tolist(), *(-x[::-1]).tolist(), 1e-300]
        yield (rng.random(n) * 100000).round(2).tolist()
        yield (2.0 ** rng.integers(-1074, 900, n) * rng.choice([-1, 1], n)).tolist()


def test_sums_are_the_nearest_doubles_in_any_partitioning(spark):
    groups = list(_groups())
    want = {g: float(sum(map(Fraction, x))) for g, x in enumerate(groups)}
    rows = [(g, v) for g, x in enumerate(groups) for v in x]
    np.random.default_rng(1).shuffle(rows)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in rows], "g long, v double")
    for parts in (1, 3, 8):
        got = {r.g: r.v for r in exact_sum(df.repartition(parts), ["g"]).collect()}
        assert got == want


def test_digits_lose_nothing(spark):
    values = [x for g in _groups(5) for x in g]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    df = with_digits(df, "v", "d")
    for r in df.collect():
        assert sum(Fraction(d.digit) * Fraction(2) ** (26 * d.place) for d in r.d) == Fraction(r.v)
        assert all(abs(d.digit) < 2**26 for d in r.d) and 1 <= len(r.d) <= 3


def test_rounding_of_wide_digits():
    rng = np.random.default_rng(4)
    for _ in range(300):
        width = int(rng.integers(1, 9))
        digit = rng.integers(-(2**62), 2**62, (5, width)) >> rng.integers(0, 62, (5, width))
        got = exact_kernels.nearest(digit, -3)
        for row, value in zip(digit.tolist(), got.tolist()):
            whole = sum(d << (26 * c) for c, d in enumerate(row))
            assert value == whole / 2**78


def test_nulls_infinities_and_empty_tables(spark):
    rows = [(1, None), (2, INF), (2, 1.0), (3, INF), (3, -INF), (4, 2.5), (4, None), (5, float("nan")), (None, 1.0), (None, 0.5)]
    df = spark.createDataFrame(rows, "place long, v double")
    got = {r.place: r.v for r in exact_sum(df, ["place"]).collect()}
    assert got[1] is None and got[2] == INF and math.isnan(got[3]) and got[4] == 2.5 and math.isnan(got[5]) and got[None] == 1.5
    assert exact_sum(df.limit(0), ["place"]).collect() == []
    assert [r.v for r in exact_sum(df.limit(0), []).collect()] == [None]
    assert [r.v for r in exact_sum(df.where("place = 4"), []).collect()] == [2.5]


@pytest.mark.parametrize("multiply", [matmul_opb_sparse, matmul_naive_sparse, matmul_ipb_sparse])
def test_products_equal_fsum(spark, multiply):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((4, 30)) * 10.0 ** rng.integers(-9, 9, (4, 30))
    b = rng.standard_normal((30, 3)) * 10.0 ** rng.integers(-9, 9, (30, 3))
    A, B = cells_of(spark, a), cells_of(spark, b)
    want = {(i, j): math.fsum(a[i, k] * b[k, j] for k in range(30)) for i in range(4) for j in range(3)}
    for light in (4_000_000, 5):
        c = multiply(A, B, light_products=light, exact=True)
        assert {(r.i, r.j): r.v for r in c.df.collect()} == want


def test_dot_and_row_merge(spark):
    x = spark.createDataFrame([(k, 0.1 * k) for k in range(50)], "k long, v double")
    assert algebra.dot(x, x, exact=True).first().v == math.fsum((0.1 * k) * (0.1 * k) for k in range(50))
    assert algebra.dot(x, x.limit(0), exact=True).first().v == 0.0
    partial = spark.createDataFrame([(0, 0, 0.1)] * 10 + [(0, 1, 0.0)], "i long, j long, v double")
    assert sorted(map(tuple, algebra.row_merge_sum(partial, exact=True).collect())) == [(0, 0, 1.0), (0, 1, 0.0)]
