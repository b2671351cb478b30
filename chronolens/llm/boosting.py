"""Gradient-boosted regression trees on a bounded table, for scoring in tasks."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of complete binary trees of a fixed depth.

    Each tree is three arrays (feature, threshold, leaf), so scoring a batch is
    ``depth`` vectorised steps a tree.
    """

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, smooth: float = 4.0):
        self.rounds, self.depth, self.rate, self.smooth = rounds, depth, rate, smooth
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(p / (1 - p)))
        values = [np.unique(x[:, j]) for j in range(x.shape[1])]
        cuts = [v if len(v) <= 17 else np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 17))) for j, v in enumerate(values)]  # a rare value of a flag counts
        cuts = [(c[:-1] + c[1:]) / 2 if len(c) > 1 else np.zeros(0) for c in cuts]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - prob, prob * (1 - prob), cuts)
            self.trees.append(tree)
            score += self._leaf(tree, x)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(g), np.int64)
        for level in range(self.depth):
            start, width = 2**level - 1, 2**level
            at = node - start
            total_g, total_h = np.bincount(at, g, width), np.bincount(at, h, width)
            best = np.full(width, 1e-6)
            for j, cut in enumerate(cuts):
                for c in cut:
                    left = x[:, j] <= c
                    lg, lh = np.bincount(at[left], g[left], width), np.bincount(at[left], h[left], width)
                    rg, rh = total_g - lg, total_h - lh
                    gain = lg**2 / (lh + self.smooth) + rg**2 / (rh + self.smooth) - total_g**2 / (total_h + self.smooth)
                    better = gain > best
                    best[better] = gain[better]
                    feature[start:][:width][better], threshold[start:][:width][better] = j, c
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        at = node - inner
        leaf = self.rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + self.smooth)
        return feature, threshold, leaf

    def _leaf(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        feature, threshold, leaf = tree
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        return leaf[node - len(feature)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._leaf(tree, x)
        return 1 / (1 + np.exp(-score))
