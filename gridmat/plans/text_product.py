"""The whole route from two text matrices to a text result, as one call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridmat import sinks, sources
from gridmat.matrix import Matrix, check_product_shape
from gridmat.plans.matmul import METHODS, matmul
from gridmat.plans.scratch import remove, scratch_path


def _sparse_operands(spark: SparkSession, a: Matrix, b: Matrix, method: str, work: str) -> tuple[Matrix, Matrix]:
    """Operands written in the sparse layouts that a method reads, and read back."""
    kind = "OPB" if method in ("OPB", "auto") else method
    path_a, path_b = sinks.write_sparse_pair(a, b, work, kind)
    read_a, read_b = (sources.read_csc, sources.read_csr) if kind == "OPB" else (sources.read_csr, sources.read_csc)
    return read_a(spark, path_a, (a.n_rows, a.n_cols)), read_b(spark, path_b, (b.n_rows, b.n_cols))


def multiply_text(
    spark: SparkSession,
    path_a: str,
    path_b: str,
    path_out: str,
    shape_a: tuple[int, int],
    shape_b: tuple[int, int],
    method: str = "auto",
    sparsity: int = 0,
    rounding: str = "exact",
    mode: str = "strict",
    compression: str | None = None,
    files: int | None = None,
    **options,
) -> Matrix:
    """Read two matrices, multiply them, write the result; returns the matrix that was written, as its text says it.

    ``sparsity`` is the declared percentage of zeros in A. At 0 the inputs are
    dense lines without ids, the product is a dense one and the result has
    three decimals, rounded up. Above 0 the inputs are dense lines with row ids:
    they are first written as CSC and CSR text without their zeros, in the
    layouts of the method, then multiplied as sparse matrices, and the result
    has row ids, unrounded numbers and ``0`` for missing cells. The sparse texts
    lie in the scratch folder and are removed once the result is written.
    ``options`` go to the product.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    if not 0 <= sparsity <= 100:
        raise ValueError(f"sparsity is a percentage, not {sparsity}")
    if sparsity == 0:
        a, b = sources.read_pair(spark, path_a, path_b, shape_a, shape_b, mode=mode)
        c = matmul(a, b, method=method, sparsity=0, **options)
        sinks.write_dense_text(c, path_out, rounding=rounding, compression=compression, files=files)
        return sources.read_dense(spark, path_out, (c.n_rows, c.n_cols))
    a, b = sources.read_pair(
        spark, path_a, path_b, shape_a, shape_b, sources.read_dense_id, zero_test="literal", mode=mode
    )
    check_product_shape(a, b)
    work = scratch_path(spark, "sparse-text")
    a, b = _sparse_operands(spark, a, b, method, work)
    c = matmul(a, b, method=method, sparsity=sparsity, **options)
    sinks.write_row_text(c, path_out, compression=compression, files=files)
    remove(spark, work)
    return sources.read_dense_id(spark, path_out, (c.n_rows, c.n_cols), zero_test="literal")


__all__ = ["multiply_text"]
