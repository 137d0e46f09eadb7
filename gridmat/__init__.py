"""Distributed matrices on Spark: read, convert, profile, multiply, write."""

from gridmat.matrix import BandMatrix, CellMatrix, VectorMatrix
from gridmat.plans.matmul import matmul
from gridmat.plans.scratch import keep
from gridmat.plans.text_product import multiply_text

__all__ = ["BandMatrix", "CellMatrix", "VectorMatrix", "keep", "matmul", "multiply_text"]
