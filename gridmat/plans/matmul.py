"""Choosing how to multiply."""

from __future__ import annotations

from gridmat.matrix import CellMatrix, Matrix, check_product_shape
from gridmat.operators import dense_product as dense
from gridmat.operators import sparse_product as sparse
from gridmat.operators.layout import drop_zeros

METHODS = ("naive", "IPB", "OPB", "auto")

def matmul(
    a: Matrix,
    b: Matrix,
    method: str = "auto",
    sparsity: int | None = None,
    **options,
) -> Matrix:
    """``A x B`` by one of the data-movement strategies.

    ``sparsity`` is the declared percentage of zeros in A: above 0 the sparse
    form of the method runs, at 0 the dense one. Left out, cell matrices count
    as sparse and matrices of dense vectors as dense. The zeros of dense vectors
    are left out when they are multiplied as sparse ones. ``auto`` takes the
    pairing on k for sparse operands and near-cubic blocks for dense ones. A
    sparse product has the structural cells and a dense one every cell of the
    shape, whatever the method and however much data there is; so are the
    options those of the form alone.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    check_product_shape(a, b)
    if sparsity is None:
        is_sparse = isinstance(a, CellMatrix)
    else:
        is_sparse = sparsity > 0
    if is_sparse:
        a, b = (m if isinstance(m, CellMatrix) else drop_zeros(m) for m in (a, b))
    if is_sparse:
        run = {
            "naive": sparse.matmul_naive_sparse,
            "IPB": sparse.matmul_ipb_sparse,
            "OPB": sparse.matmul_opb_sparse,
            "auto": sparse.matmul_opb_sparse,
        }[method]
    else:
        run = {
            "naive": dense.matmul_naive_dense,
            "IPB": dense.matmul_ipb_dense,
            "OPB": dense.matmul_opb_dense,
            "auto": dense.matmul_blocks,
        }[method]
    return run(a, b, **options)
