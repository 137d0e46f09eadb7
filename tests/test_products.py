"""All multiplication strategies give the same answer."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from gridmat import keep, matmul
from gridmat.operators import dense_product as dense
from gridmat.operators import kernels
from gridmat.operators import sparse_product as sparse
from gridmat.operators.algebra import add
from gridmat.sources import matrix_generate
from helpers import array_of, cells_of, places_of, random_pair, structural, vectors_of

SPARSE = {
    "opb": sparse.matmul_opb_sparse,
    "opb cut": lambda a, b: sparse.matmul_opb_sparse(a, b, light_products=3),
    "ipb": sparse.matmul_ipb_sparse,
    "ipb blocks": lambda a, b: sparse.matmul_ipb_sparse(a, b, (3, 2, 4)),
    "naive": sparse.matmul_naive_sparse,
}
DENSE = {
    "ipb": dense.matmul_ipb_dense,
    "ipb blocks": lambda a, b: dense.matmul_ipb_dense(a, b, (3, 100, 4)),
    "ipb strips": lambda a, b: dense.matmul_ipb_dense(a, b, (2, 2, 5)),
    "blocks": dense.matmul_blocks,
    "opb": dense.matmul_opb_dense,
    "opb strips": lambda a, b: dense.matmul_opb_dense(a, b, (4, 1, 9)),
    "naive": dense.matmul_naive_dense,
}


@pytest.mark.parametrize("how", SPARSE)
@pytest.mark.parametrize("seed", [0, 1])
def test_sparse(spark, how, seed):
    a, b = random_pair(seed)
    c = SPARSE[how](cells_of(spark, a), cells_of(spark, b))
    assert np.array_equal(array_of(c), a @ b)
    assert places_of(c) == structural(a, b)


@pytest.mark.parametrize("how", DENSE)
@pytest.mark.parametrize("form", ["cells", "rows", "columns", "mixed"])
def test_dense(spark, how, form):
    a, b = random_pair(3)
    if form == "cells":
        left, right = cells_of(spark, a), cells_of(spark, b)
    elif form == "mixed":
        left, right = vectors_of(spark, a, "col"), cells_of(spark, b)
    else:
        by = form[:3]
        left, right = vectors_of(spark, a, by), vectors_of(spark, b, by)
    c = DENSE[how](left, right)
    assert np.array_equal(array_of(c), a @ b)
    # a dense result has every cell of the shape, zeros included
    assert places_of(c) == {(i, j) for i in range(7) for j in range(9)}


@pytest.mark.parametrize("how", ["ipb blocks", "ipb strips", "opb strips", "naive"])
def test_dense_zero_matrix_keeps_its_shape(spark, how):
    a, b = np.zeros((7, 5)), np.zeros((5, 9))
    c = DENSE[how](cells_of(spark, a), cells_of(spark, b))
    assert places_of(c) == {(i, j) for i in range(7) for j in range(9)}
    assert not array_of(c).any()


def test_cancelled_sum_is_kept(spark):
    a, b = np.array([[1.0, 1.0]]), np.array([[2.0], [-2.0]])
    for how in SPARSE.values():
        c = how(cells_of(spark, a), cells_of(spark, b))
        assert [tuple(r) for r in c.df.select("i", "j", "v").collect()] == [(0, 0, 0.0)]


def test_stored_zero_counts_as_a_factor(spark):
    a, b = np.array([[0.0]]), np.array([[3.0]])
    keep = np.array([[True]])
    c = sparse.matmul_opb_sparse(cells_of(spark, a, keep), cells_of(spark, b, keep))
    assert places_of(c) == {(0, 0)}


def test_golden_case(spark):
    """Column 1 of A is empty: pairing by position instead of k would shift it."""
    a = np.array([[1, 0, 2], [0, 0, 3.0]])
    b = np.array([[4, 5], [6, 7], [0, 8.0]])
    c = sparse.matmul_opb_sparse(cells_of(spark, a), cells_of(spark, b))
    got = {(r["i"], r["j"]): r["v"] for r in c.df.collect()}
    assert got == {(0, 0): 4.0, (0, 1): 21.0, (1, 1): 24.0}


def test_many_strips_are_summed_once_per_block(spark):
    """Several blocks per row band: sums of one block must not reach the next."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, (13, 30)), rng.integers(0, 9, (30, 11))
    c = dense.matmul_opb_dense(vectors_of(spark, a), vectors_of(spark, b), (4, 1, 3))
    assert np.array_equal(array_of(c), a @ b)


def test_sums_inside_tasks_come_first(spark):
    """More strips than tasks: each task adds up its own parts before the shuffle."""
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 9, (4, 90)), rng.integers(0, 9, (90, 3))
    c = dense.matmul_opb_dense(vectors_of(spark, a), vectors_of(spark, b), (3, 1, 2))
    assert c.df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert np.array_equal(array_of(c), a @ b)


def test_partial_sums_over_small_batches(spark):
    """Parts of one sum arrive in several batches of the summing task."""
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 9, (5, 40)), rng.integers(0, 9, (40, 6))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        c = dense.block_product(vectors_of(spark, a), vectors_of(spark, b), 5, 2, 4)
        assert np.array_equal(array_of(c), a @ b)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_algebra(spark):
    a, b = random_pair(8)
    c = random_pair(9)[1]
    A, B, C = (cells_of(spark, x) for x in (a, b, c))
    opb = sparse.matmul_opb_sparse
    assert np.array_equal(array_of(opb(A, B).T), array_of(opb(B.T, A.T)))
    assert np.array_equal(array_of(opb(A, add(B, C))), array_of(add(opb(A, B), opb(A, C))))
    eye = cells_of(spark, np.eye(5))
    assert np.array_equal(array_of(opb(A, eye)), a)
    assert places_of(opb(A, eye)) == places_of(A)


def test_generated_matrix_times_itself(spark):
    g = matrix_generate(spark, 40, 40, sparsity=80, seed=3)
    x = array_of(g)
    for method in ("naive", "IPB", "OPB", "auto"):
        for sparsity in (0, 80):
            c = matmul(g, g, method, sparsity)
            assert np.array_equal(array_of(c), x @ x)
            if sparsity:
                assert places_of(c) == structural(x, x)


@pytest.mark.parametrize("k", [3, 200])
def test_auto_gives_structural_cells_however_many_products_pile_up(spark, k):
    rng = np.random.default_rng(k)
    a, b = rng.integers(1, 5, (4, k)).astype(float), rng.integers(1, 5, (k, 6)).astype(float)
    a[2], b[:, 0], b[:, 3] = 0, 0, 0
    A, B = cells_of(spark, a), cells_of(spark, b)
    for method in ("auto", "OPB", "IPB", "naive"):
        c = matmul(A, B, method)
        assert np.array_equal(array_of(c), a @ b) and places_of(c) == structural(a, b)
    assert np.array_equal(array_of(matmul(A, B, "auto", light_products=5)), a @ b)
    with pytest.raises(TypeError):
        matmul(A, B, "auto", edges=(2, 2, 2))


def test_no_inner_dimension(spark):
    A, B = vectors_of(spark, np.zeros((3, 0))), vectors_of(spark, np.zeros((0, 2)), "col")
    for how in DENSE.values():
        assert np.array_equal(array_of(how(A, B)), np.zeros((3, 2)))


@pytest.mark.parametrize("method", ["naive", "IPB", "OPB", "auto"])
def test_dense_vectors_as_sparse(spark, method):
    a, b = random_pair(16)
    c = matmul(vectors_of(spark, a), vectors_of(spark, b, "col"), method, sparsity=40)
    assert np.array_equal(array_of(c), a @ b)
    assert places_of(c) == structural(a, b)


def test_product_of_products(spark):
    a, b = random_pair(17)
    c = dense.matmul_ipb_dense(vectors_of(spark, a), vectors_of(spark, b), (3, 5, 4))
    d = dense.matmul_opb_dense(c, vectors_of(spark, b.T), (4, 3, 5))
    assert np.array_equal(array_of(d), a @ b @ b.T)
    assert np.array_equal(array_of(sparse.matmul_opb_sparse(c, cells_of(spark, b.T))), a @ b @ b.T)


def test_bad_arguments(spark):
    a, b = random_pair(0)
    A, B = cells_of(spark, a), cells_of(spark, b)
    with pytest.raises(ValueError, match="unknown method"):
        matmul(A, B, "ABC")
    for how in (*SPARSE.values(), *DENSE.values()):
        with pytest.raises(ValueError, match="inner dimensions"):
            how(A, A)
    with pytest.raises(ValueError, match="shapes differ"):
        add(A, B)


def test_kept_matrix(spark):
    a, b = random_pair(15)
    kept = keep(sparse.matmul_opb_sparse(cells_of(spark, a), cells_of(spark, b)))
    plan = kept.df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Join" not in plan
    assert np.array_equal(array_of(matmul(kept, kept.T, "OPB")), (a @ b) @ (a @ b).T)
    bands = keep(dense.matmul_ipb_dense(vectors_of(spark, a), vectors_of(spark, b)))
    assert np.array_equal(array_of(bands), a @ b)


def test_kernels_need_no_package_on_executors():
    """A process that cannot import the package can still load the kernels."""
    code = cloudpickle.dumps((kernels.fill, kernels.block_multiply, kernels.add_runs))
    load = "import pickle, sys; print(len(pickle.loads(sys.stdin.buffer.read())))"
    done = subprocess.run(
        [sys.executable, "-c", load], input=code, capture_output=True, cwd="/", check=True
    )
    assert done.stdout.strip() == b"3"
