"""Discounts of modified Kneser-Ney smoothing."""

from __future__ import annotations

import numpy as np


def discounts(t: list[float]) -> np.ndarray:
    """Modified discounts for counts 1, 2 and 3 or more, kept within (0, count), from how many n-grams have count 1, 2, 3 and 4."""
    if not t[0] or not t[1]:
        return np.array([0.5, 0.75, 0.9])
    y = t[0] / (t[0] + 2 * t[1])
    d = [k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return np.clip(d, 0.05, [0.95, 1.9, 2.8])
