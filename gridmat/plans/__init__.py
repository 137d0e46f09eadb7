from gridmat.plans.matmul import matmul
from gridmat.plans.text_product import multiply_text

__all__ = ["matmul", "multiply_text"]
