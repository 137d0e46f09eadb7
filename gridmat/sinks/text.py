"""Writing matrices as text.

Every writer replaces the output folder by default and takes ``compression``
(such as ``"gzip"``) and a number of ``files``. Every file holds one run of ids,
sorted, so reading the part files in name order gives the ids in order, without
one task ever holding the whole output. Sparse lines are cut into files by their
bytes: files are about equally long however full single rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmat.functions.text import dense_line
from gridmat.matrix import BandMatrix, Matrix, VectorMatrix
from gridmat.operators.layout import GATHERED_COLUMNS, LINE_SPAN, densify_rows, lines_in_place, row_lines, to_csc, to_csr, whole_lines
from gridmat.operators.ordering import sort_into_files, with_file


def _save(
    lines: DataFrame, path: str, compression: str | None, mode: str, by: list[str] | None = None, level: str | None = None
) -> None:
    writer = lines.select(*(by or []), "line").write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if compression:
        writer = writer.option("compression", compression)
    if level:
        writer = writer.option("zlib.compress.level", level)
    writer.text(path)


# Bytes that an entry of a sparse line takes, and one of a row with its missing cells written out, about.
_PAIR_BYTES, _VALUE_BYTES = 10, 4


def _sparse(lists: DataFrame, n_along: int, n_ids: int, files: int | None) -> tuple[DataFrame, int]:
    """Sparse lines with their file: files are about equally long, whatever the lengths of lines and the gaps between ids."""
    weight = F.size("entries") * _PAIR_BYTES + 8
    return with_file(whole_lines(lists, n_along), "id", n_ids, files, weight, lists)


def _sorted_files(placed: DataFrame, n_files: int) -> DataFrame:
    return placed.repartitionById(n_files, "_file").sortWithinPartitions("id")


def as_rows(m: Matrix) -> VectorMatrix:
    """All rows of the shape as dense vectors, rows without a value as zeros."""
    if isinstance(m, BandMatrix):
        return m.rows()
    if not isinstance(m, VectorMatrix) or m.by == "col":
        return densify_rows(m, all_rows=True)
    if m.complete:
        return m
    # Every row once more without a vector; max() takes the vector where there is one.
    kind = m.df.schema["vec"].dataType
    blank = m.df.sparkSession.range(m.n_rows).select("id", F.lit(None).cast(kind).alias("vec"))
    zeros = F.array_repeat(F.lit(0.0), m.n_cols)
    rows = m.df.unionByName(blank).groupBy("id").agg(F.coalesce(F.max("vec"), zeros).alias("vec"))
    return VectorMatrix(rows, m.n_rows, m.n_cols, complete=True)


def dense_lines(m: Matrix, rounding: str = "exact", files: int | None = None) -> DataFrame:
    """Result text of every row of the shape, in files by row number: ``(id, line)``."""
    rows = sort_into_files(as_rows(m).df, "id", m.n_rows, files=files)
    return rows.select("id", dense_line(F.col("vec"), rounding).alias("line"))


def write_dense_text(
    m: Matrix,
    path: str,
    rounding: str = "exact",
    compression: str | None = None,
    mode: str = "overwrite",
    files: int | None = None,
) -> None:
    """``v v v `` per row, three decimals rounded up, no row id."""
    _save(dense_lines(m, rounding, files), path, compression, mode)


def write_row_text(
    m: Matrix,
    path: str,
    all_rows: bool = False,
    compression: str | None = None,
    mode: str = "overwrite",
    files: int | None = None,
    level: str | None = None,
) -> None:
    """``rowId v v 0 v `` per row, values unrounded, missing cells as ``0``.

    Rows go to their file as lists of entries and become text there. ``level`` is
    that of gzip, such as ``"BEST_SPEED"``.
    """
    lists = to_csr(m, empty_rows=all_rows)
    # Every column takes two bytes at least.
    weight = F.size("entries") * _VALUE_BYTES + min(2 * m.n_cols, 2 * LINE_SPAN)
    if m.n_cols > GATHERED_COLUMNS:
        placed = with_file(row_lines(m, all_rows=all_rows), "id", m.n_rows, files, weight, lists)
        lines = _sorted_files(*placed)
    else:
        placed, n_files = with_file(lists, "id", m.n_rows, files, weight, lists)
        lines = lines_in_place(placed.repartitionById(n_files, "_file"), m.n_cols)
    _save(lines, path, compression, mode, level=level)


def write_csr(
    m: Matrix,
    path: str,
    compression: str | None = None,
    mode: str = "overwrite",
    files: int | None = None,
) -> None:
    _save(_sorted_files(*_sparse(to_csr(m), m.n_cols, m.n_rows, files)), path, compression, mode)


def write_csc(
    m: Matrix,
    path: str,
    compression: str | None = None,
    mode: str = "overwrite",
    files: int | None = None,
) -> None:
    _save(_sorted_files(*_sparse(to_csc(m), m.n_rows, m.n_cols, files)), path, compression, mode)


def _sparse_pair(a: Matrix, b: Matrix, method: str) -> list[tuple[str, DataFrame, int, int]]:
    """The form, the lists and the shape of both operands, in the layouts that a method reads."""
    csr = lambda m: ("CSR", to_csr(m), m.n_cols, m.n_rows)
    csc = lambda m: ("CSC", to_csc(m), m.n_rows, m.n_cols)
    if method == "OPB":
        return [csc(a), csr(b)]
    if method in ("IPB", "naive"):
        return [csr(a), csc(b)]
    raise ValueError(f"unknown method {method!r}")


def write_sparse_pair(
    a: Matrix,
    b: Matrix,
    path: str,
    method: str,
    compression: str | None = None,
    mode: str = "overwrite",
    files: int | None = None,
) -> tuple[str, str]:
    """Operands as sparse text in the layouts a method reads; returns the folders of A and B.

    One plan writes both: lines of either form are routed to partitions of their
    own, and each form to a folder below ``path``. Neither operand waits for the
    other, and each is read once.
    """
    routed, first, folders = None, 0, []
    for form, lists, n_along, n_ids in _sparse_pair(a, b, method):
        placed, n_files = _sparse(lists, n_along, n_ids, files)
        part = placed.select(F.lit(form).alias("form"), "id", "line", (F.col("_file") + first).alias("_file"))
        routed = part if routed is None else routed.unionByName(part)
        first += n_files
        folders.append(f"{path}/form={form}")
    # In the order that writing by folder asks for, so that it sorts nothing again.
    sorted_lines = routed.repartitionById(first, "_file").sortWithinPartitions("form", "id")
    _save(sorted_lines, path, compression, mode, by=["form"])
    spark = a.df.sparkSession
    for folder in folders:  # an operand without any line has a folder too
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return folders[0], folders[1]


__all__ = [
    "as_rows",
    "dense_lines",
    "write_csc",
    "write_csr",
    "write_dense_text",
    "write_row_text",
    "write_sparse_pair",
]
