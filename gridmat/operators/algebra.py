"""Elementwise and vector algebra on cell matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmat.matrix import CellMatrix, Matrix, check_product_shape, check_same_shape
from gridmat.operators.exact_sum import exact_sum


def scale(m: Matrix, factor: float) -> CellMatrix:
    cells = m.cells().df.select("i", "j", (F.col("v") * F.lit(float(factor))).alias("v"))
    return CellMatrix(cells, m.n_rows, m.n_cols)


def row_merge_sum(partial: DataFrame, exact: bool = False) -> DataFrame:
    """Partial rows merged: values of the same cell are added.

    The sum is taken inside each task before the shuffle and again after it,
    so a cell with very many parts arrives as one row per task. ``exact`` gives
    the double next to the true sum, whatever the order and partitioning.
    """
    if exact:
        return exact_sum(partial, ["i", "j"])
    return partial.groupBy("i", "j").agg(F.sum("v").alias("v"))


def add(a: Matrix, b: Matrix) -> CellMatrix:
    """Sum of two matrices; a cell is there when either operand has it."""
    check_same_shape(a, b)
    both = a.cells().df.unionByName(b.cells().df)
    return CellMatrix(row_merge_sum(both), a.n_rows, a.n_cols)


def dot(x: DataFrame, y: DataFrame, exact: bool = False) -> DataFrame:
    """Dot product of two sparse vectors ``(k, v)`` as a one-row table; ``exact`` as in ``row_merge_sum``, over the rounded products."""
    pairs = x.select("k", F.col("v").alias("x")).join(y.select("k", F.col("v").alias("y")), "k")
    if exact:
        return exact_sum(pairs.select((F.col("x") * F.col("y")).alias("v")), []).select(F.coalesce("v", F.lit(0.0)).alias("v"))
    total = F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0))
    return pairs.agg(total.alias("v"))


def row_vector(m: Matrix, i: int) -> DataFrame:
    return m.cells().df.filter(F.col("i") == i).select(F.col("j").alias("k"), "v")


def col_vector(m: Matrix, j: int) -> DataFrame:
    return m.cells().df.filter(F.col("j") == j).select(F.col("i").alias("k"), "v")


def outer_product(a: Matrix, b: Matrix) -> DataFrame:
    """The rank-1 terms of a product, one matrix per k: ``(k, i, j, v)``.

    Filtering the result on one ``k`` gives the outer product of that column
    with that row; the filter reaches both scans.
    """
    from gridmat.operators.joins import k_join

    check_product_shape(a, b)
    return k_join(a, b).select("k", "i", "j", (F.col("a") * F.col("b")).alias("v"))
