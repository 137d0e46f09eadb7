"""Generated matrices."""

from __future__ import annotations

import math

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmat.functions.coords import with_each
from gridmat.matrix import CellMatrix
from gridmat.sources import kernels

cloudpickle.register_pickle_by_value(kernels)

# Fixed values of the arithmetic hash: small primes, so that no product of
# reduced indices leaves BIGINT and any SQL engine gives the same numbers.
MODULUS = 1000003
ROW_FACTOR = 7919
COL_FACTOR = 104729


def cell_hash(i: Column, j: Column, seed: int) -> Column:
    modulus = F.lit(MODULUS).cast("bigint")
    mixed = (i % modulus) * ROW_FACTOR + (j % modulus) * COL_FACTOR + seed
    return ((mixed % modulus) * (mixed % modulus)) % modulus


def generate_on(
    ids: DataFrame, n_rows: int, n_cols: int, sparsity: int, seed: int = 0
) -> CellMatrix:
    """Random cells for the row ids in column ``i`` of ``ids``.

    ``sparsity`` is the percentage of cells left out. Every cell depends on its
    own indices only, so tasks need no shared state and a lost task repeats
    its cells exactly. Values are whole numbers 1..9.
    """
    if not 0 <= sparsity <= 100:
        raise ValueError("sparsity is a percentage from 0 to 100")
    i, j = F.col("i"), F.col("j")
    grid = with_each(ids.select(F.col("i").cast("bigint").alias("i")), "j", n_cols)
    hashed = grid.select("i", "j", cell_hash(i, j, seed).alias("h"))
    kept = hashed.filter(F.col("h") % 100 >= sparsity)
    value = 1 + F.call_function("div", F.col("h"), F.lit(100)) % 9
    return CellMatrix(kept.select("i", "j", value.cast("double").alias("v")), n_rows, n_cols)


def matrix_generate(
    spark: SparkSession, n_rows: int, n_cols: int, sparsity: int, seed: int = 0
) -> CellMatrix:
    ids = spark.range(n_rows).select(F.col("id").alias("i"))
    return generate_on(ids, n_rows, n_cols, sparsity, seed)


# Cells that one task draws at a time, on average.
_RUN_CELLS = 4096


def generate_sparse(
    spark: SparkSession, n_rows: int, n_cols: int, density: float, seed: int = 0, skew: float = 0.0
) -> CellMatrix:
    """Random cells at a cost that follows the cells, not the shape.

    Each column of a row holds a cell with probability ``density``; instead of
    trying every column, a row jumps from cell to cell by geometric gaps. With
    ``skew`` s above 0 row i has the probability ``density * c * (i + 1)**-s`` (at
    most 1), c chosen so that rows have ``density`` on average: few long rows,
    many short ones. Gaps and values (whole numbers 1..9) come from a hash of
    seed, row, place in the row's list of draws; so the same seed gives the same
    cells on any number of partitions, and a lost task repeats its own exactly.

    Rows are cut into runs of columns that hold about _RUN_CELLS cells; a jump
    that leaves a run is drawn anew in the next one, which changes nothing, as a
    geometric gap does not remember how far it has come. Light rows are many to
    a batch, heavy ones many tasks wide.
    """
    if not 0.0 <= density <= 1.0:
        raise ValueError("density is a share from 0 to 1")
    if skew < 0.0:
        raise ValueError("skew is 0 or more")
    rows = spark.range(n_rows).select(F.col("id").alias("i"))
    share = F.lit(float(density))
    if skew:
        share = share * F.lit(n_rows / _power_sum(n_rows, skew)) * F.pow(F.col("i") + 1, F.lit(-float(skew)))
    p = F.least(F.lit(1.0), share)
    width = F.least(F.lit(n_cols).cast("double"), F.ceil(F.try_divide(F.lit(float(_RUN_CELLS)), p)).cast("double")).cast("bigint")
    runs = rows.select("i", p.alias("p"), width.alias("width")).filter(F.col("p") > 0)
    n_runs = F.call_function("div", F.lit(n_cols).cast("bigint") + F.col("width") - 1, F.col("width"))
    runs = runs.select("i", "p", "width", F.explode(F.sequence(F.lit(0).cast("bigint"), n_runs - 1)).alias("run"))
    # Rows of a range lie in few partitions; the heavy ones come first, so runs are dealt out.
    dealt = runs.repartition(_tasks(spark), "i", "run") if skew else runs
    cells = dealt.mapInArrow(kernels.jump_cells(n_cols, seed), "i bigint, j bigint, v double")
    return CellMatrix(cells, n_rows, n_cols)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _power_sum(n: int, s: float) -> float:
    """Sum of i**-s for i = 1..n: the first terms one by one, the rest by an integral with its first corrections."""
    head = min(n, 10_000)
    total = sum(i**-s for i in range(1, head + 1))
    if n > head:
        tail = math.log(n / head) if s == 1.0 else (n ** (1 - s) - head ** (1 - s)) / (1 - s)
        total += tail + (n**-s - head**-s) / 2
    return total
