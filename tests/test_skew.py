"""Hot keys: results stay whole and no task gets the whole key."""

import numpy as np
from pyspark.sql import functions as F

from gridmat.operators.joins import grid_edges, grid_pairs, heavy_cuts, k_join, row_col_join, unit_cuts
from gridmat.operators.layout import from_entries, to_csc, to_csr
from gridmat.operators.sparse_product import matmul_ipb_sparse, matmul_naive_sparse, matmul_opb_sparse
from helpers import array_of, cells_of


def hot_pair(n=60, k=40, m=50):
    """Column 7 of A and row 7 of B are full and hold a good part of all cells."""
    rng = np.random.default_rng(11)
    a = (rng.random((n, k)) < 0.05) * rng.integers(1, 9, (n, k)).astype(float)
    b = (rng.random((k, m)) < 0.05) * rng.integers(1, 9, (k, m)).astype(float)
    a[:, 7], b[7, :] = 3.0, 2.0
    return a, b


def cuts_of(a, b, light):
    return {k: (x, y) for k, x, y in heavy_cuts(a, b, light).collect()}


def test_hot_key_is_found_and_cut(spark):
    a, b = hot_pair()
    cuts = cuts_of(cells_of(spark, a), cells_of(spark, b), 100)
    cuts_a, cuts_b = cuts[7]
    assert cuts_a * cuts_b >= 60 * 50 / 100
    assert cuts_a > 1 and cuts_b > 1


def test_no_heavy_key(spark):
    a, b = hot_pair()
    assert cuts_of(cells_of(spark, a), cells_of(spark, b), 5000) == {}


def test_many_keys_of_middle_weight_are_all_cut(spark):
    """No share of the total lets a key through: the fullest part stays near the limit."""
    A, B = cells_of(spark, np.ones((30, 40))), cells_of(spark, np.ones((40, 30)))
    cuts = cuts_of(A, B, 100)
    assert len(cuts) == 40
    assert all((30 / x) * (30 / y) <= 1.5 * 100 for x, y in cuts.values())


def test_building_a_product_starts_no_job(spark):
    a, b = hot_pair()
    A, B = cells_of(spark, a), cells_of(spark, b)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    k_join(A, B, 10)
    matmul_opb_sparse(A, B, 10)
    matmul_naive_sparse(A, B)
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_copies_go_only_where_both_sides_meet(spark):
    a, b = np.zeros((8, 6)), np.zeros((6, 8))
    a[0, 1] = a[7, 1] = a[3, 2] = b[1, 0] = b[2, 7] = b[4, 4] = 1.0
    pairs = grid_pairs(cells_of(spark, a), cells_of(spark, b), 2, 6, 2)
    assert {tuple(r) for r in pairs.select("bi", "bj", "k").collect()} == {(0, 0, 1), (3, 0, 1), (1, 3, 2)}


def test_cut_key_gives_every_pair_once(spark):
    a, b = hot_pair()
    A, B = cells_of(spark, a), cells_of(spark, b)
    plain = {tuple(r) for r in k_join(A, B).collect()}
    rows = [tuple(r) for r in k_join(A, B, light_products=50).collect()]
    assert len(rows) == len(set(rows)) == len(plain)
    assert set(rows) == plain
    c = matmul_opb_sparse(A, B, light_products=50)
    assert np.array_equal(array_of(c), a @ b)


def test_one_sided_heat(spark):
    """A long column of A against a single cell of B: only A can be cut."""
    a, b = np.zeros((500, 3)), np.zeros((3, 2))
    a[:, 1], b[1, 0] = 2.0, 5.0
    A, B = cells_of(spark, a), cells_of(spark, b)
    [(k, (cuts_a, cuts_b))] = cuts_of(A, B, 50).items()
    assert (k, cuts_b) == (1, 1) and cuts_a >= 10
    assert np.array_equal(array_of(matmul_opb_sparse(A, B, light_products=50)), a @ b)


def test_grid_units_are_bounded(spark):
    """A full row and a full column never give a unit more than its edges allow."""
    a, b = hot_pair()
    a[4, :], b[:, 9] = 1.0, 1.0
    pairs = row_col_join(cells_of(spark, a), cells_of(spark, b), (16, 8, 16))
    top = pairs.groupBy("bi", "bj", "bk").agg(
        F.countDistinct("i", "k").alias("a"), F.countDistinct("k", "j").alias("b")
    ).agg(F.max("a"), F.max("b")).first()
    assert top[0] <= 16 * 8 and top[1] <= 8 * 16


def test_long_lines_are_cut_and_merge_back(spark):
    a, _ = hot_pair()
    A = cells_of(spark, a)
    for build, by in ((to_csr, "row"), (to_csc, "col")):
        lines = build(A, span=16)
        assert lines.agg(F.max(F.size("entries"))).first()[0] <= 16
        assert lines.agg(F.max("part")).first()[0] > 0
        assert np.array_equal(array_of(from_entries(lines, a.shape, by)), a)


def _corner(n, full):
    """A matrix with a full corner and one loose cell; as cells, without a dense array."""
    a = np.zeros((n, n))
    a[:full, :full] = 1.0
    a[n - 1, n - 1] = 1.0
    return a


def test_a_full_corner_is_spread(spark):
    """All products lie in one unit of the grid, and no task gets many more than the limit."""
    a = cells_of(spark, _corner(400, 60))
    edges, limit = (100, 400, 100), 20_000
    assert [tuple(r) for r in unit_cuts(grid_pairs(a, a, *edges), 16, limit).collect()] == [(0, 0, 0, 11)]
    pairs = row_col_join(a, a, edges, limit)
    of_parts = pairs.groupBy("task", "bi", "bj", "bk", "part").count()
    assert of_parts.agg(F.sum("count")).first()[0] == 60**3 + 1
    # 11 parts of 216,000 products; every k gives 3,600 to one of them.
    assert of_parts.count() == 12 and of_parts.agg(F.max("count")).first()[0] <= 2 * limit
    by_task = pairs.groupBy("task").count().agg(F.max("count"), F.count("task")).first()
    assert by_task[0] <= 2 * limit and by_task[1] >= 10
    assert np.array_equal(array_of(matmul_ipb_sparse(a, a, edges, limit)), _corner(400, 60) @ _corner(400, 60))


def test_a_full_row_against_full_columns_is_spread(spark):
    a, b = np.zeros((50, 3000)), np.zeros((3000, 40))
    a[7, :], b[:, :10] = 1.0, 2.0
    A, B = cells_of(spark, a), cells_of(spark, b)
    pairs = row_col_join(A, B, (50, 3000, 40), 2000)
    assert pairs.groupBy("part").count().agg(F.max("count")).first()[0] <= 2 * 2000
    assert np.array_equal(array_of(matmul_ipb_sparse(A, B, (50, 3000, 40), 2000)), a @ b)


def test_a_key_with_most_cells_is_dealt_out_by_blocks(spark):
    a, b = hot_pair(n=200, m=160)
    A, B = cells_of(spark, a), cells_of(spark, b)
    pairs = grid_pairs(A, B, 10, 40, 10, light_products=500)
    rows = pairs.withColumn("at", F.spark_partition_id()).where("k = 7")
    assert rows.count() == 20 * 16
    assert rows.select("at").distinct().count() > 2
    assert np.array_equal(array_of(matmul_ipb_sparse(A, B, (10, 40, 10), 500)), a @ b)


def test_a_grid_with_very_many_units_sends_a_bounded_table(spark, monkeypatch):
    from gridmat.operators import joins

    monkeypatch.setattr(joins, "MOST_CUT_UNITS", 5)
    a = cells_of(spark, np.ones((30, 30)))
    cuts = unit_cuts(grid_pairs(a, a, 5, 30, 5), 36, 10)
    assert cuts.count() <= 5
    assert np.array_equal(array_of(matmul_ipb_sparse(a, a, (5, 30, 5), 10)), np.full((30, 30), 30.0))


def test_short_runs_need_no_counts(spark):
    a = cells_of(spark, np.ones((6, 6)))
    rows, depth, cols = grid_edges(a, a)
    assert rows * depth * cols <= 4_000_000
    plan = matmul_ipb_sparse(a, a).df._jdf.queryExecution().optimizedPlan().toString()
    assert "ceil" not in plan.lower()


def test_naive_cuts_rows_and_copies_only_b(spark):
    a, b = hot_pair()
    A, B = cells_of(spark, a), cells_of(spark, b)
    cuts = {k: (x, y) for k, x, y in heavy_cuts(A, B, 100, rows_only=True).collect()}
    assert cuts[7] == (30, 1)
    assert np.array_equal(array_of(matmul_naive_sparse(A, B, 100)), a @ b)
