"""Cells drawn by jumps: their number, their spread, and the same ones every time."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmat.sources import generate, generate_sparse
from gridmat.sources.kernels import _cells


def _set(m):
    return {tuple(r) for r in m.df.collect()}


def test_same_seed_same_cells_on_any_partitioning(spark, monkeypatch):
    want = _set(generate_sparse(spark, 300, 500, 0.03, seed=5))
    assert len(want) == len({(i, j) for i, j, _ in want})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert _set(generate_sparse(spark, 300, 500, 0.03, seed=5)) == want
    skewed = _set(generate_sparse(spark, 300, 500, 0.03, seed=5, skew=0.8))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert _set(generate_sparse(spark, 300, 500, 0.03, seed=5, skew=0.8)) == skewed
    assert _set(generate_sparse(spark, 300, 500, 0.03, seed=6)) != want


def test_draws_do_not_depend_on_their_neighbours():
    def alone(rows, draws):
        from gridmat.sources import kernels

        kernels._DRAWS, kept = draws, kernels._DRAWS
        i = np.array(rows)
        out = {(a, b, c) for x in _cells(i, np.zeros_like(i), np.full(len(i), 0.2), np.full(len(i), 400), 400, 1) for a, b, c in zip(*x)}
        kernels._DRAWS = kept
        return out

    together = alone([3, 4, 9], 1 << 20)
    assert together == alone([3], 16) | alone([4], 64) | alone([9], 1 << 20)


def test_every_column_is_as_likely(spark):
    m = generate_sparse(spark, 4000, 60, 0.1, seed=2)
    by_column = np.array([r[1] for r in sorted(map(tuple, m.df.groupBy("j").count().collect()))])
    assert len(by_column) == 60 and abs(by_column - 400).max() < 5.5 * 19
    values = [r[0] for r in m.df.groupBy("v").count().orderBy("v").collect()]
    assert values == [float(x) for x in range(1, 10)]


def test_short_runs_change_nothing_in_the_mean(spark, monkeypatch):
    monkeypatch.setattr(generate, "_RUN_CELLS", 3)
    m = generate_sparse(spark, 500, 1000, 0.05, seed=8)
    n = m.df.count()
    assert abs(n - 25_000) < 5.5 * 154
    assert m.df.agg(F.min("j"), F.max("j")).first()[1] < 1000


def test_rows_of_a_power_law(spark):
    m = generate_sparse(spark, 2000, 3000, 0.005, seed=3, skew=0.9)
    counts = {r.i: r["count"] for r in m.df.groupBy("i").count().collect()}
    assert abs(sum(counts.values()) - 30_000) < 3000
    assert counts[0] > 20 * np.median([counts.get(i, 0) for i in range(2000)])
    weights = generate._power_sum(200_000, 0.9), sum(i**-0.9 for i in range(1, 200_001))
    assert weights[0] == pytest.approx(weights[1], rel=1e-6)


@pytest.mark.parametrize("density", [0.0, 1.0])
def test_ends_of_the_scale(spark, density):
    m = generate_sparse(spark, 7, 11, density)
    assert m.df.count() == int(77 * density)
    for bad in ({"density": 1.5}, {"density": 0.5, "skew": -1.0}):
        with pytest.raises(ValueError):
            generate_sparse(spark, 7, 11, **bad)


def test_cost_follows_the_cells(spark):
    start = time.perf_counter()
    m = generate_sparse(spark, 1_000_000, 1_000_000, 1e-5, seed=1)
    n = m.df.agg(F.count("v"), F.max("j")).first()
    assert abs(n[0] - 10_000_000) < 5.5 * 3162 and n[1] > 999_000
    assert time.perf_counter() - start < 60
