"""Size and density of matrices, and the load of a blocked product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridmat.functions.coords import n_blocks
from gridmat.matrix import Matrix, check_product_shape
from gridmat.operators.joins import block_counts

# Bytes a number takes while a block is worked on.
BYTES_PER_CELL = 10


def nnz(m: Matrix) -> DataFrame:
    """Cells of a matrix. Values are counted, not rows, because the check of the indices hangs on the value."""
    return m.cells().df.agg(F.count("v").alias("nnz"))


def observe_nnz(m: Matrix) -> tuple[DataFrame, Observation]:
    """The cells, and their count as a by-product of whatever job reads them."""
    seen = Observation()
    return m.cells().df.observe(seen, F.count("v").alias("nnz")), seen


def matrix_profile(m: Matrix) -> DataFrame:
    """One row: shape, cells, density, and how full rows and columns are.

    Each cell is counted under its row and its column in the same shuffle.
    Averages are over rows and columns that have a cell.
    """
    lines = F.explode(
        F.array(
            F.struct(F.lit(0).alias("axis"), F.col("i").alias("id")),
            F.struct(F.lit(1).alias("axis"), F.col("j").alias("id")),
        )
    )
    counts = m.cells().df.select(lines.alias("l"), "v").groupBy("l.axis", "l.id").agg(
        F.count("v").alias("n")
    )
    of_rows = F.when(F.col("axis") == 0, F.col("n"))
    of_cols = F.when(F.col("axis") == 1, F.col("n"))
    size = float(m.n_rows) * float(m.n_cols)
    return counts.agg(
        F.lit(m.n_rows).cast("bigint").alias("n_rows"),
        F.lit(m.n_cols).cast("bigint").alias("n_cols"),
        F.coalesce(F.sum(of_rows), F.lit(0)).alias("nnz"),
        (F.coalesce(F.sum(of_rows), F.lit(0)).cast("double") / F.lit(size)).alias("density"),
        F.count(of_rows).alias("used_rows"),
        F.count(of_cols).alias("used_cols"),
        F.max(of_rows).alias("max_row_nnz"),
        F.max(of_cols).alias("max_col_nnz"),
        (F.sum(of_rows).cast("double") / F.count(of_rows)).alias("avg_row_nnz"),
        (F.sum(of_cols).cast("double") / F.count(of_cols)).alias("avg_col_nnz"),
    )


def block_load(
    a: Matrix,
    b: Matrix,
    row_edge: int,
    depth: int,
    col_edge: int,
    budget_bytes: int,
) -> DataFrame:
    """Work units of a blocked product with their size against a memory budget.

    ``map_cells`` is what the unit holds when its blocks are dense (ragged
    last blocks counted at their true size), ``reduce_cells`` what the sum of
    its output block over all strips of k receives, ``n_a`` and ``n_b`` the
    cells really stored.
    """
    check_product_shape(a, b)
    units = block_counts(a, b, row_edge, depth, col_edge)

    def extent(block: str, edge: int, total: int):
        left = F.lit(total).cast("bigint") - F.col(block) * F.lit(edge).cast("bigint")
        return F.least(F.lit(edge).cast("bigint"), left)

    r = extent("bi", row_edge, a.n_rows)
    k = extent("bk", depth, a.n_cols)
    c = extent("bj", col_edge, b.n_cols)
    strips = n_blocks(a.n_cols, depth)
    sized = units.select(
        "bi", "bk", "bj", "n_a", "n_b",
        (r * k + k * c + r * c).alias("map_cells"),
        (r * c * F.lit(strips).cast("bigint")).alias("reduce_cells"),
    )
    budget = F.lit(budget_bytes).cast("bigint")
    over = (F.col("map_cells") * BYTES_PER_CELL > budget) | (
        F.col("reduce_cells") * BYTES_PER_CELL > budget
    )
    return sized.withColumn("over_budget", over)
