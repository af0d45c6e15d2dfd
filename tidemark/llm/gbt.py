"""Gradient-boosted regression trees for two classes, small and on arrays: binned features, logistic loss."""

from __future__ import annotations

import numpy as np


class Forest:
    """Complete binary trees of one depth: node i splits to 2i+1 and 2i+2; a leaf's value is in the last level."""

    def __init__(self, base: float, cuts: list[np.ndarray], feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray) -> None:
        self.base, self.cuts, self.feature, self.threshold, self.leaf = base, cuts, feature, threshold, leaf

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, weight: np.ndarray | None = None) -> Forest:
    """Newton boosting on at most ``bins`` quantile bins per feature. Deterministic."""
    n, k = x.shape
    w = np.ones(n) if weight is None else weight
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    mean = float(np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3))
    base, inner = float(np.log(mean / (1 - mean))), 2**depth - 1
    score = np.full(n, base)
    feature, threshold, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for tree in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            best_gain, best = np.full(2**level, 1e-6), {}
            for j in range(k):
                size = len(cuts[j]) + 1
                if size == 1:
                    continue
                slot = (at - first) * size + code[:, j]
                gs = np.bincount(slot, g, 2**level * size).reshape(2**level, size).cumsum(1)
                hs = np.bincount(slot, h, 2**level * size).reshape(2**level, size).cumsum(1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (total_g - gs)**2 / (total_h - hs + l2) - total_g**2 / (total_h + l2)
                top = gain[:, :-1].argmax(1)
                for node in np.flatnonzero(gain[np.arange(len(top)), top] > best_gain):
                    best_gain[node], best[int(node)] = gain[node, top[node]], (j, cuts[j][top[node]])
            for node, (j, cut) in best.items():
                feature[tree, first + node], threshold[tree, first + node] = j, cut
            at = 2 * at + 1 + (x[np.arange(n), feature[tree, at]] > threshold[tree, at])
        gs, hs = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        leaves[tree] = rate * gs / (hs + l2)
        score += leaves[tree][at - inner]
    return Forest(base, cuts, feature, threshold, leaves)
