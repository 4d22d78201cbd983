"""A small gradient-boosted tree classifier for a few numeric features, fitted on bounded samples."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Boosted regression trees on logistic loss, with splits at the sample's own feature values."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8, shrink: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.shrink = rounds, depth, rate, least, shrink
        self.prior = 0.0
        self.trees: list[list[tuple[int, float, int, int, float]]] = []  # nodes: feature (-1: leaf), cut, left, right, value

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        mean = float(np.average(y, weights=weight))
        self.prior = float(np.log(mean / (1 - mean)))
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33), method="nearest")) for c in x.T]
        bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
        raw = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            tree: list = []
            self._grow(tree, bins, cuts, grad, hess, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            raw += self._apply(tree, x)
        return self

    def _grow(self, tree: list, bins, cuts, grad, hess, rows: np.ndarray, depth: int) -> int:
        node = len(tree)
        g, h = grad[rows].sum(), hess[rows].sum()
        tree.append((-1, 0.0, 0, 0, self.rate * g / (h + self.shrink)))
        if depth == 0 or len(rows) < 2 * self.least:
            return node
        best = (1e-9, -1, 0)
        for f, c in enumerate(cuts):
            b = bins[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, weights=v, minlength=len(c) + 1))[:-1] for v in (grad[rows], hess[rows], np.ones(len(rows))))
            ok = (ns >= self.least) & (len(rows) - ns >= self.least)
            gain = np.where(ok, gs**2 / (hs + self.shrink) + (g - gs) ** 2 / (h - hs + self.shrink) - g**2 / (h + self.shrink), 0)
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] >= 0:
            _, f, k = best
            low = bins[rows, f] <= k
            left = self._grow(tree, bins, cuts, grad, hess, rows[low], depth - 1)
            right = self._grow(tree, bins, cuts, grad, hess, rows[~low], depth - 1)
            tree[node] = (f, float(cuts[f][k]), left, right, 0.0)
        return node

    @staticmethod
    def _apply(tree: list, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            n = at[rows]
            at[rows] = np.where(x[rows, feature[n]] <= cut[n], left[n], right[n])
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.prior)
        for tree in self.trees:
            raw += self._apply(tree, x)
        return 1 / (1 + np.exp(-raw))
