"""Gradient-boosted trees with logistic loss over binned dense features, and isotonic calibration (numpy only)."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Level-wise trees of fixed depth; each node splits at the bin with the best second-order gain."""

    def __init__(self, trees: int = 70, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 15, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
        binned = self._bin(x)
        share = min(max(float(y.mean()) if n else 0.0, 1e-4), 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(n, self.start)
        flat = binned + np.arange(width) * self.bins
        for _ in range(self.trees if n else 0):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins, np.int64)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                key = ((at - first)[:, None] * (width * self.bins) + flat).ravel()
                shape = (many, width, self.bins)
                g, h, c = (np.bincount(key, np.repeat(w, width), many * width * self.bins).reshape(shape).cumsum(2) for w in (grad, hess, np.ones(n)))
                whole = [z[:, :1, -1:] for z in (g, h, c)]
                gain = g**2 / (h + self.ridge) + (whole[0] - g) ** 2 / (whole[1] - h + self.ridge) - whole[0] ** 2 / (whole[1] + self.ridge)
                gain[(c < self.least) | (whole[2] - c < self.least)] = 0
                best = gain.reshape(many, -1).argmax(1)
                good = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
                feature[first : first + many] = np.where(good, best // self.bins, 0)
                cut[first : first + many] = np.where(good, best % self.bins, self.bins)
                at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut[at])
            leaf = at - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, grad, 2**self.depth) / (np.bincount(leaf, hess, 2**self.depth) + self.ridge)
            self.nodes.append((feature, cut, value))
            score += value[leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1) if len(self.cuts) else np.zeros((len(x), 0), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, score, rows = self._bin(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            score += value[at - (2**self.depth - 1)]
        return score


class Isotonic:
    """Least-squares non-decreasing map from margins to probabilities (pool adjacent violators)."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        self.x, self.y = np.zeros(0), np.zeros(0)
        if not len(x):
            return self
        values, place = np.unique(x, return_inverse=True)
        weight = np.bincount(place)
        mean = np.bincount(place, y) / weight
        level: list[list[float]] = []  # mean, weight, first, last
        for i in range(len(values)):
            level.append([mean[i], weight[i], i, i])
            while len(level) > 1 and level[-2][0] >= level[-1][0]:
                m, w, _, last = level.pop()
                top = level[-1]
                top[:] = [(top[0] * top[1] + m * w) / (top[1] + w), top[1] + w, top[2], last]
        self.x = np.array([values[i] for _, _, a, b in level for i in (int(a), int(b))])
        self.y = np.array([m for m, *_ in level for _ in (0, 1)])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0, 1) if len(self.x) else np.zeros(len(x))
