from gridmat.sinks.text import (
    as_rows,
    dense_lines,
    write_csc,
    write_csr,
    write_dense_text,
    write_row_text,
    write_sparse_pair,
)

__all__ = [
    "as_rows",
    "dense_lines",
    "write_csc",
    "write_csr",
    "write_dense_text",
    "write_row_text",
    "write_sparse_pair",
]
