"""How many cells a sparse product will have, without forming it.

The columns that a row of the product reaches are the union of the rows of B
under the k of that row of A. Every row of B becomes a small bottom-k sketch of
its columns (the columns with the smallest ranks, ranks being hashes); the
sketches under the k of a row of A are united, and their estimates added. So k
is passed over once, and what moves is a sketch for each k and each row, not a
product for each pair. Rows with fewer columns than a sketch holds are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmat.matrix import CellMatrix, Matrix, check_product_shape
from gridmat.operators.joins import _sides
from gridmat.operators.row_product import row_product
from gridmat.operators.sparse_product import matmul_opb_sparse

# A sketch keeps up to 2**SKETCH_LOG columns, 8 bytes each: about 3 percent of error for a row. Rows share their
# ranks, so the error of their sum is not much less.
SKETCH_LOG = 10
# Products for a cell of the result from which on records of rows move less than single cells.
FULL_CELLS = 4.0


def row_reach(a: Matrix, b: Matrix, sketch_log: int = SKETCH_LOG) -> DataFrame:
    """Estimated cells of every row of the product that has any: ``(i, cells)``."""
    check_product_shape(a, b)
    left, right = _sides(a, b)
    sketches = right.groupBy("k").agg(F.theta_sketch_agg("j", F.lit(sketch_log)).alias("s"))
    reached = left.select("i", "k").join(sketches, "k").groupBy("i").agg(F.theta_union_agg("s", F.lit(sketch_log)).alias("s"))
    return reached.select("i", F.theta_sketch_estimate("s").cast("double").alias("cells"))


def product_size(a: Matrix, b: Matrix, sketch_log: int = SKETCH_LOG) -> DataFrame:
    """One row: products that will be formed (exact), result cells (estimated) and rows: ``(products, cells, rows)``."""
    left, right = _sides(a, b)
    n_a = left.groupBy("k").agg(F.count("a").alias("n_a"))
    n_b = right.groupBy("k").agg(F.count("b").alias("n_b"))
    products = n_a.join(n_b, "k").agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("products"))
    cells = row_reach(a, b, sketch_log).agg(F.coalesce(F.sum("cells"), F.lit(0.0)).alias("cells"), F.count("i").alias("rows"))
    return cells.select(products.scalar().alias("products"), "cells", "rows")


def matmul_by_size(a: Matrix, b: Matrix, **options) -> CellMatrix:
    """The sparse product by the way that moves less; the cells are the same.

    Many products for each cell are added up in records of whole rows, few are
    summed cell by cell in the engine. Runs one job, the estimate, while the
    product is built; ``matmul`` never does.
    """
    size = product_size(a, b).first()
    full = size["products"] >= FULL_CELLS * max(size["cells"], 1.0)
    return row_product(a, b, **options) if full else matmul_opb_sparse(a, b, **options)


__all__ = ["matmul_by_size", "product_size", "row_reach"]
