"""Matrices over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmat.functions import arrays
from gridmat.matrix import CellMatrix, VectorMatrix, inside


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_table(
    df: DataFrame,
    i: str | Column,
    j: str | Column,
    v: str | Column,
    shape: tuple[int, int],
) -> CellMatrix:
    """Cells ``(i, j)`` of a table; values that share a cell are added.

    A null value is no cell; an index outside the shape fails the job.
    """
    cells = (
        df.select(
            _column(i).cast("bigint").alias("i"),
            _column(j).cast("bigint").alias("j"),
            _column(v).cast("double").alias("v"),
        )
        .filter(F.col("v").isNotNull())
        .select("i", "j", inside(F.col("v"), *shape).alias("v"))
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
    )
    return CellMatrix(cells, *shape)


def from_vectors(
    df: DataFrame,
    id: str | Column,
    vec: str | Column,
    shape: tuple[int, int],
    by: str = "row",
) -> VectorMatrix:
    """Dense rows (or columns) that a table already holds as arrays.

    A vector shorter than the shape counts as zero beyond its end; a longer
    one, or an id outside the shape, fails the job.
    """
    vectors = df.select(
        _column(id).cast("bigint").alias("id"),
        _column(vec).cast("array<double>").alias("vec"),
    )
    width, count = (shape[1], shape[0]) if by == "row" else shape
    fitted = inside(arrays.fit(F.col("vec"), width), count, i="id")
    return VectorMatrix(vectors.select("id", fitted.alias("vec")), *shape, by=by)


def shape_of(cells: DataFrame) -> tuple[int, int]:
    """Smallest shape that holds all cells. Runs one aggregate job."""
    top = cells.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
    return (0, 0) if top["i"] is None else (top["i"] + 1, top["j"] + 1)
