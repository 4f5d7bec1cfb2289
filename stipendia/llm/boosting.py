"""A small gradient-boosted tree classifier: logistic loss, histogram splits, fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of ``depth`` levels, all splits of a node on one binned feature; missing nothing, plain numbers only."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 24, weight: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.weight = rounds, depth, rate, bins, weight

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(binned, edges, y - p, p * (1 - p))
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _grow(self, binned, edges, gradient, curvature):
        inner = 2 ** self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(binned), np.int64)
        for level in range(self.depth):
            first = 2 ** level - 1
            for at in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == at)
                if len(rows) < 8:
                    continue
                g, h = gradient[rows], curvature[rows]
                whole, best = g.sum() ** 2 / (h.sum() + self.weight), 1e-6
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, f], g, len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, f], h, len(e) + 1))[:-1]
                    gain = (left_g ** 2 / (left_h + self.weight) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + self.weight)) - whole
                    if gain.max() > best:
                        best, feature[at], cut[at] = gain.max(), f, e[gain.argmax()]
            limit = np.array([len(edges[f]) if np.isinf(c) else np.searchsorted(edges[f], c, side="right") - 1
                              for f, c in zip(feature, cut)])
            node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > limit[node])
        leaf = node - inner
        value = np.zeros(inner + 1)
        np.add.at(value, leaf, gradient)
        weight = np.bincount(leaf, curvature, inner + 1) + self.weight
        return (feature, cut, self.rate * value / weight), leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2 ** self.depth - 1)]
        return out
