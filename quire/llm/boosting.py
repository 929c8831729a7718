"""Gradient-boosted trees for a binary label on dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Histogram trees of fixed depth, grown level by level on logistic loss."""

    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 2.0
    least: float = 3.0  # least hessian weight of a leaf
    edges: list[np.ndarray] = field(default_factory=list)
    forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, threshold bin, leaf values
    base: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, features = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(features)]
        # Features that are mostly zero still get cuts among their other values.
        for j in range(features):
            rest = x[x[:, j] != 0, j]
            if len(rest):
                self.edges[j] = np.unique(np.concatenate([self.edges[j], np.quantile(rest, np.linspace(0, 1, self.bins // 2)), [0.0]]))
        width = max(len(e) for e in self.edges) + 1
        binned = self._binned(x)
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            split_feature, split_bin = np.full((1 << self.depth) - 1, -1), np.zeros((1 << self.depth) - 1, np.int64)
            for level in range(self.depth):
                count, first = 1 << level, (1 << level) - 1
                best = np.full(count, 1e-6)
                for j in range(features):
                    key = (node * width + binned[:, j]).astype(np.int64)
                    gs = np.cumsum(np.bincount(key, g, count * width).reshape(count, width), axis=1)
                    hs = np.cumsum(np.bincount(key, h, count * width).reshape(count, width), axis=1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (ga - gs) ** 2 / (ha - hs + self.ridge) - ga**2 / (ha + self.ridge)
                    gain[(hs < self.least) | (ha - hs < self.least)] = 0
                    at = gain.argmax(axis=1)
                    value = gain[np.arange(count), at]
                    better = value > best
                    best[better] = value[better]
                    split_feature[first : first + count][better] = j
                    split_bin[first : first + count][better] = at[better]
                node = self._step(node, first, split_feature, split_bin, binned)
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.forest.append((split_feature, split_bin, value))
            margin += value[node]
        return self

    @staticmethod
    def _step(node: np.ndarray, first: int, feature: np.ndarray, cut: np.ndarray, binned: np.ndarray) -> np.ndarray:
        f = feature[first + node]
        right = binned[np.arange(len(node)), np.maximum(f, 0)] > cut[first + node]
        return 2 * node + (right & (f >= 0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._binned(x), np.full(len(x), self.base)
        for feature, cut, value in self.forest:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = self._step(node, (1 << level) - 1, feature, cut, binned)
            out += value[node]
        return out


@dataclass
class Isotonic:
    """The non-decreasing step fit of labels on margins, by pooling adjacent violators; linear between steps."""

    at: np.ndarray = field(default_factory=lambda: np.zeros(0))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []  # sum of labels, weight, sum of margins
        for m, t in zip(margin[order].tolist(), y[order].tolist(), strict=True):
            pools.append([t, 1.0, m])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                t2, w2, m2 = pools.pop()
                pools[-1] = [pools[-1][0] + t2, pools[-1][1] + w2, pools[-1][2] + m2]
        self.at = np.array([p[2] / p[1] for p in pools])
        self.value = np.array([p[0] / p[1] for p in pools])
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value) if len(self.at) else np.full(len(margin), 0.0)
