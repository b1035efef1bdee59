"""Small gradient-boosted trees for a bounded sample: histogram splits, logistic loss, numpy only."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees over binned features; `margin` is the sum of leaf values."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(rate / (1 - rate)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
        if not 0 < y.sum() < len(y):
            return self
        b, f = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._leaf(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full binary tree in heap order: feature (-1: goes left), last bin of the left side, leaf values."""
        inner = 2**self.depth - 1
        feature, cut, value = np.full(inner, -1), np.zeros(inner, int), np.zeros(inner + 1)
        at = np.zeros(len(g), int)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = (1e-6, -1, 0)
            total_g, total_h = g[mine].sum(), h[mine].sum()
            for j in range(b.shape[1] if len(mine) >= 2 * self.least else 0):
                width = len(self.edges[j]) + 1
                sg, sh, n = (np.cumsum(np.bincount(b[mine, j], w, width))[:-1] for w in (g[mine], h[mine], None))
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain[(n < self.least) | (len(mine) - n < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
            feature[node], cut[node] = best[1:]
            at[mine] = 2 * node + 1 + ((b[mine, best[1]] > best[2]) if best[1] >= 0 else 0)
        for leaf in range(inner + 1):
            mine = at == inner + leaf
            value[leaf] = self.rate * g[mine].sum() / (h[mine].sum() + 1)
        return feature, cut, value

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(b), int)
        for _ in range(self.depth):
            j = feature[at]
            at = 2 * at + 1 + ((j >= 0) & (b[np.arange(len(b)), j] > cut[at]))
        return value[at - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.trees and len(x):
            b = self._binned(x)
            for tree in self.trees:
                out += self._leaf(tree, b)
        return out


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the calibrated probability 1 / (1 + exp(-(a * margin + b))), by Newton steps."""
    a, b = 1.0, 0.0
    if not 0 < y.sum() < len(y):
        return a, b
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ (a, b), -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (x * w[:, None]) + 1e-3 * np.eye(2), x.T @ (goal - p) - 1e-3 * np.array([a - 1, b]))
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)
