"""Placing cells in a block grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n_blocks(length: int, edge: int) -> int:
    """Blocks needed for ``length``, the ragged last one included."""
    return -(-length // edge)


def square_edges(n_rows: int, n_cols: int, units: int, longest: int) -> tuple[int, int]:
    """Edges of near-square blocks that cut a shape into about ``units`` blocks.

    Square blocks need the fewest copies of the operands. No edge exceeds
    ``longest``, so a block's size is bounded whatever the shape.
    """
    side = max(1, math.isqrt(max(1, n_rows * n_cols // max(1, units))))
    col_edge = max(1, min(n_cols, side, longest))
    row_cuts = n_blocks(max(1, units), n_blocks(n_cols, col_edge) or 1)
    row_edge = max(1, min(n_blocks(n_rows, row_cuts), longest))
    return row_edge, col_edge


def cube_edges(
    n_rows: int, inner: int, n_cols: int, units: int, longest: int, deepest: int
) -> tuple[int, int, int]:
    """Edges of near-cubic work units, about ``units`` of them.

    Cubes move the least: a unit takes in two faces and gives out one, for a
    volume of multiplications. Sides that are too short for that stay whole.
    """
    side = round((n_rows * inner * n_cols / max(1, units)) ** (1 / 3))
    depth = max(1, min(inner, side, deepest))
    rows, cols = square_edges(n_rows, n_cols, units // max(1, n_blocks(inner, depth)), longest)
    return rows, depth, cols


def block_of(index: Column, edge: int) -> Column:
    """Block number of a 0-based index: contiguous strips of ``edge``."""
    return F.call_function("div", index, F.lit(edge))


def within_block(index: Column, edge: int) -> Column:
    return index % F.lit(edge).cast("bigint")


def cyclic_group(index: Column, n_groups: int) -> Column:
    """Deal indices round-robin over ``n_groups``."""
    return index % F.lit(n_groups).cast("bigint")


def with_each(df: DataFrame, name: str, n: int, run: int = 10_000) -> DataFrame:
    """Every row once for each number 0..n-1, which is put in column ``name``.

    Long ranges are counted out in two steps, so that no task holds more than
    ``run`` numbers at a time and none of them become part of the plan.
    """
    if n < 1:
        return df.filter(F.lit(False)).withColumn(name, F.lit(0).cast("bigint"))
    if n <= run:
        return df.withColumn(name, F.explode(_numbers(F.lit(0), F.lit(n - 1))))
    first = F.col("_run") * run
    runs = df.withColumn("_run", F.explode(_numbers(F.lit(0), F.lit(n_blocks(n, run) - 1))))
    in_run = F.explode(_numbers(first, F.least(first + run, F.lit(n).cast("bigint")) - 1))
    return runs.withColumn(name, in_run).drop("_run")


def _numbers(first: Column, last: Column) -> Column:
    return F.sequence(first.cast("bigint"), last.cast("bigint"))
