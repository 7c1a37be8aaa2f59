"""Gradient-boosted trees on histograms, and isotonic regression, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Binary classifier with logistic loss; every tree is complete to ``depth``, so scoring is array lookups."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 1.0):
        self.n, self.depth, self.rate, self.least = trees, depth, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        grid = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        binned = np.stack([np.searchsorted(g, c, side="left") for g, c in zip(grid, x.T, strict=True)], 1)
        p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.base)
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-raw))
            grad, hess = y - q, np.maximum(q * (1 - q), 1e-9)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, wide = 2**level - 1, 2**level
                best = np.full(wide, 1e-9)
                for f, g in enumerate(grid):
                    if not len(g):
                        continue
                    where = (node - first) * (len(g) + 1) + binned[:, f]
                    gl = np.cumsum(np.bincount(where, grad, wide * (len(g) + 1)).reshape(wide, -1), 1)
                    hl = np.cumsum(np.bincount(where, hess, wide * (len(g) + 1)).reshape(wide, -1), 1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gl, hl = gl[:, :-1], hl[:, :-1]
                    gain = gl**2 / (hl + self.least) + (gt - gl) ** 2 / (ht - hl + self.least) - gt**2 / (ht + self.least)
                    k = gain.argmax(1)
                    got = gain[np.arange(wide), k]
                    better = got > best
                    best = np.where(better, got, best)
                    feature[first : first + wide] = np.where(better, f, feature[first : first + wide])
                    cut[first : first + wide] = np.where(better, g[k], cut[first : first + wide])
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, grad, 2**self.depth) / (np.bincount(leaf, hess, 2**self.depth) + self.least)
            raw += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(value)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


class Isotonic:
    """The non-decreasing least-squares fit (pool adjacent violators), linear between its steps."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Isotonic":
        order = np.argsort(x, kind="stable")
        at, start = np.unique(np.asarray(x, np.float64)[order], return_index=True)
        sums = np.add.reduceat(np.asarray(y, np.float64)[order], start) if len(at) else np.zeros(0)
        sizes = np.diff([*start, len(order)])
        blocks: list[list[float]] = []  # first x, last x, sum, size
        for a, s, n in zip(at, sums, sizes, strict=True):
            blocks.append([a, a, s, n])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
        self.x = np.array([v for b in blocks for v in (b[:1] if b[0] == b[1] else b[:2])] or [0.0])
        self.y = np.array([b[2] / b[3] for b in blocks for _ in (b[:1] if b[0] == b[1] else b[:2])] or [0.5])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)
