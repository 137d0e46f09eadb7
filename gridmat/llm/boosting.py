"""Gradient-boosted trees for two classes, on quantised features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Complete binary trees of one depth as arrays: split feature and threshold by inner node, value by leaf."""

    def __init__(self, depth: int = 4, trees: int = 40, rate: float = 0.3, least: float = 5.0, decay: float = 1.0):
        self.depth, self.trees, self.rate, self.least, self.decay = depth, trees, rate, least, decay
        self.feature: list[np.ndarray] = []
        self.threshold: list[np.ndarray] = []
        self.value: list[np.ndarray] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        n, features = x.shape
        weight = np.ones(n) if weight is None else weight
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for f in range(features)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        mean = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        margin = np.full(n, self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = (p - y) * weight, p * (1 - p) * weight
            inner = (1 << self.depth) - 1
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                here = node - first
                best = np.zeros(count)
                total_g, total_h = np.bincount(here, g, count), np.bincount(here, h, count)
                for f in range(features):
                    if not len(cuts[f]):
                        continue
                    width = len(cuts[f]) + 1
                    key = here * width + binned[:, f]
                    left_g = np.bincount(key, g, count * width).reshape(count, width).cumsum(axis=1)[:, :-1]
                    left_h = np.bincount(key, h, count * width).reshape(count, width).cumsum(axis=1)[:, :-1]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + self.decay) + right_g**2 / (right_h + self.decay) - (total_g**2 / (total_h + self.decay))[:, None]
                    gain[(left_h < self.least * 0.01) | (right_h < self.least * 0.01)] = 0
                    pick = gain.argmax(axis=1)
                    gain = gain[np.arange(count), pick]
                    better = gain > best + 1e-9
                    best = np.where(better, gain, best)
                    feature[first : first + count][better] = f
                    threshold[first : first + count][better] = cuts[f][pick[better]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
            leaf = node - inner
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + self.decay)
            self.feature.append(feature)
            self.threshold.append(threshold)
            self.value.append(value)
            margin += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out
