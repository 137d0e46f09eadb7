"""Products whose inner dimension is short: copies are bounded and no partial row is sent."""

import numpy as np
import pytest

from gridmat.matrix import CellMatrix
from gridmat.operators import joins, row_product, sparse_kernels
from gridmat.operators.sparse_product import matmul_ipb_sparse, matmul_opb_sparse
from helpers import array_of, cells_of, places_of, random_pair, structural
from test_plans import plan_of


@pytest.mark.parametrize("edge, rows", [(2000, 1 << 18), (3, 2)])
def test_tiles_are_finished_in_place(spark, monkeypatch, edge, rows):
    monkeypatch.setattr(row_product, "TILE_EDGE", edge)
    monkeypatch.setattr(sparse_kernels, "TILE_ROWS", rows)
    a, b = random_pair(6, n=40, k=4, m=37)
    A, B = cells_of(spark, a), cells_of(spark, b)
    c = row_product.tile_product(A, B)
    assert np.array_equal(array_of(c), a @ b) and places_of(c) == structural(a, b)


def test_a_result_larger_than_its_operands_is_not_shuffled(spark):
    """One shuffle, of the operands; records of partial rows would be one more."""
    a = np.zeros((90, 3))
    a[:, 1], a[::7, 2] = 3.0, 2.0
    A = cells_of(spark, a)
    c = matmul_opb_sparse(A, A.T, light_products=10)
    assert plan_of(c.df).count("Exchange") == 1
    assert np.array_equal(array_of(c), a @ a.T)


def test_a_hot_k_is_cut_no_finer_than_keeps_tasks_busy(spark):
    a = np.ones((400, 1))
    A = cells_of(spark, a)
    [(_, x, y)] = joins.heavy_cuts(A, A.T, 10).collect()
    assert 500 <= x * y <= 2 * joins.BUSY_PARTS
    pairs = joins.k_join(A, A.T, 10)
    assert pairs.count() == pairs.distinct().count() == 400 * 400


def test_neighbouring_blocks_share_what_is_sent(spark):
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 3, s).astype(float) for s in ((64, 40), (40, 24)))
    A, B = cells_of(spark, a), cells_of(spark, b)
    edges = (1, 8, 1)
    rows, depth, cols = joins.sent_edges(A, B, edges, 32)
    assert rows * cols > 1 and depth == 8 and -(-64 // rows) * -(-24 // cols) * 5 >= 32
    pairs = joins.row_col_join(A, B, edges).collect()
    assert {(p.bi, p.bj, p.bk) for p in pairs} <= {(i, j, k) for i in range(64) for j in range(24) for k in range(5)}
    assert all((p.bi, p.bj, p.bk) == (p.i, p.j, p.k // 8) for p in pairs)
    assert np.array_equal(array_of(matmul_ipb_sparse(A, B, edges)), a @ b)


def test_copies_of_a_very_hot_k_do_not_grow_with_its_products(spark):
    """4e10 products under one k: with parts of a fixed size each cell would be copied 100 times."""
    n = 200_000
    a = CellMatrix(spark.range(n).selectExpr("id as i", "0L as j", "1D as v"), n, 1)
    [(_, x, y)] = joins.heavy_cuts(a, a.T, 1000).collect()
    assert max(x, y) <= 32 and 500 <= x * y <= joins.BUSY_PARTS


def test_tiles_of_one_task_share_what_is_sent(spark, monkeypatch):
    monkeypatch.setattr(row_product, "TILE_EDGE", 2)
    monkeypatch.setattr(sparse_kernels, "TILE_EDGE", 2)
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3, (64, 2)).astype(float), rng.integers(0, 3, (2, 61)).astype(float)
    A, B = cells_of(spark, a), cells_of(spark, b)
    rows, cols = row_product.sent_tile_edges(A, B)
    assert -(-64 // rows) <= 4 and -(-61 // cols) <= 4  # 32 and 31 tiles of two
    c = row_product.tile_product(A, B)
    assert np.array_equal(array_of(c), a @ b) and places_of(c) == structural(a, b)
