from gridmat.sources.generate import generate_on, generate_sparse, matrix_generate
from gridmat.sources.tables import from_table, from_vectors, shape_of
from gridmat.sources.text import (
    line_profile,
    numbered_lines,
    read_csc,
    read_csr,
    read_dense,
    read_dense_id,
    read_pair,
)

__all__ = [
    "from_table",
    "from_vectors",
    "generate_on",
    "generate_sparse",
    "line_profile",
    "matrix_generate",
    "numbered_lines",
    "read_csc",
    "read_csr",
    "read_dense",
    "read_dense_id",
    "read_pair",
    "shape_of",
]
