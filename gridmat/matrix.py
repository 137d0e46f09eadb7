"""Matrix forms: a DataFrame plus the shape that its indices live in.

Three forms, all lazy, all 0-based:

* ``CellMatrix``   one row per stored cell, ``(i BIGINT, j BIGINT, v DOUBLE)``;
  at most one per place (``from_table`` and ``row_merge_sum`` add up several)
* ``VectorMatrix`` one row per dense vector, ``(id BIGINT, vec ARRAY<DOUBLE>)``,
  holding either the rows or the columns of the matrix; ``complete`` says that
  every id of the shape is known to be there (a missing vector counts as zero)
* ``BandMatrix``   dense rows cut into bands of equal width,
  ``(i BIGINT, band BIGINT, vec ARRAY<DOUBLE>)``; what the block products return.
  ``adjoining`` says that the bands of a row follow each other in one partition, in order
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmat.operators import kernels


def inside(value: Column, n_rows: int, n_cols: int | None = None, i: str = "i", j: str = "j") -> Column:
    """A value whose indices lie inside the shape; others, null ones included, fail the job.

    The check hangs on the value, so that conditions on an index still reach the source.
    """
    fits = F.col(i).between(0, n_rows - 1)
    where = F.col(i).cast("string")
    if n_cols is not None:
        fits &= F.col(j).between(0, n_cols - 1)
        where = F.concat_ws(", ", F.col(i).cast("string"), F.col(j).cast("string"))
    shape = f"{n_rows}" if n_cols is None else f"{n_rows} x {n_cols}"
    wrong = F.raise_error(F.concat(F.lit("index outside the shape: ("), where, F.lit(f") of {shape}")))
    return F.when(fits, value).otherwise(wrong)


@dataclass(frozen=True)
class CellMatrix:
    df: DataFrame
    n_rows: int
    n_cols: int

    @classmethod
    def of(cls, df: DataFrame, n_rows: int, n_cols: int) -> CellMatrix:
        """Cells from outside: a null value is no cell, an index outside the shape fails the job."""
        cells = df.filter(F.col("v").isNotNull())
        return cls(cells.select("i", "j", inside(F.col("v"), n_rows, n_cols).alias("v")), n_rows, n_cols)

    @property
    def T(self) -> CellMatrix:
        swapped = self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        return CellMatrix(swapped, self.n_cols, self.n_rows)

    def cells(self) -> CellMatrix:
        return self


@dataclass(frozen=True)
class VectorMatrix:
    df: DataFrame
    n_rows: int
    n_cols: int
    by: str = "row"
    complete: bool = False

    def __post_init__(self):
        if self.by not in ("row", "col"):
            raise ValueError(f"by must be 'row' or 'col', not {self.by!r}")

    @property
    def T(self) -> VectorMatrix:
        """Transposing relabels the vectors; no data moves."""
        other = "col" if self.by == "row" else "row"
        return VectorMatrix(self.df, self.n_cols, self.n_rows, other, self.complete)

    def cells(self) -> CellMatrix:
        # The outer form, because the plain one adds a filter on the vector's size
        # below, which computes the vector a second time.
        spread = self.df.select("id", F.posexplode_outer("vec").alias("pos", "v"))
        pos = F.col("pos").cast("bigint")
        i, j = (F.col("id"), pos) if self.by == "row" else (pos, F.col("id"))
        # An element without a value is no cell.
        cells = spread.filter(F.col("pos").isNotNull() & F.col("v").isNotNull()).select(i.alias("i"), j.alias("j"), "v")
        return CellMatrix(cells, self.n_rows, self.n_cols)


@dataclass(frozen=True)
class BandMatrix:
    df: DataFrame
    n_rows: int
    n_cols: int
    width: int
    adjoining: bool = False

    def cells(self) -> CellMatrix:
        spread = self.df.select("i", "band", F.posexplode_outer("vec").alias("pos", "v"))
        j = F.col("band") * F.lit(self.width).cast("bigint") + F.col("pos")
        out = spread.select("i", j.alias("j"), "v").filter(F.col("j") < self.n_cols)
        return CellMatrix(out, self.n_rows, self.n_cols)

    def rows(self) -> VectorMatrix:
        """Put the finished bands of each row side by side; nothing is summed."""
        n_bands = -(-self.n_cols // self.width)
        if n_bands == 1:
            whole = self.df.select(F.col("i").alias("id"), "vec")
        elif self.adjoining:
            whole = self.df.mapInArrow(kernels.join_bands, "id BIGINT, vec ARRAY<DOUBLE>")
        else:
            parts = F.sort_array(F.collect_list(F.struct("band", "vec")))
            whole = self.df.groupBy(F.col("i").alias("id")).agg(
                F.flatten(F.transform(parts, lambda p: p["vec"])).alias("vec")
            )
        vec = F.slice("vec", 1, self.n_cols)
        rows = whole.select("id", vec.alias("vec"))
        return VectorMatrix(rows, self.n_rows, self.n_cols, complete=True)


Matrix = CellMatrix | VectorMatrix | BandMatrix


def check_product_shape(a: Matrix, b: Matrix) -> None:
    if a.n_cols != b.n_rows:
        raise ValueError(
            f"inner dimensions differ: {a.n_rows}x{a.n_cols} times {b.n_rows}x{b.n_cols}"
        )


def check_same_shape(a: Matrix, b: Matrix) -> None:
    if (a.n_rows, a.n_cols) != (b.n_rows, b.n_cols):
        raise ValueError(
            f"shapes differ: {a.n_rows}x{a.n_cols} and {b.n_rows}x{b.n_cols}"
        )
