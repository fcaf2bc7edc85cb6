"""Small gradient-boosted trees and isotonic regression in numpy (for bounded training samples)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic gradient boosting over histogram bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 8, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        # a value that most rows share leaves few quantiles: add some among the others
        for f, e in enumerate(self.edges):
            rest = x[:, f][x[:, f] > x[:, f].min()]
            if len(rest) and len(e) < self.bins // 2:
                self.edges[f] = np.unique(np.concatenate([e, [np.nextafter(x[:, f].min(), np.inf)], np.quantile(rest, np.linspace(0, 1, self.bins // 2)[:-1])]))
        binned = self._bin(x)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        self.trees = []
        raw = np.full(len(y), self.start)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            raw += self._apply(tree, binned, np.arange(len(y)), np.zeros(len(y)))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = self.rate * total_g / (total_h + self.ridge)
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None)
        for f in range(b.shape[1]):
            width = len(self.edges[f]) + 1
            if width < 2:
                continue
            col = b[rows, f]
            sg, sh, n = (np.cumsum(np.bincount(col, w, width))[:-1] for w in (g[rows], h[rows], None))
            gain = sg**2 / (sh + self.ridge) + (total_g - sg) ** 2 / (total_h - sh + self.ridge) - total_g**2 / (total_h + self.ridge)
            gain[(n < self.least) | (len(rows) - n < self.least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
        if best[1] is None:
            return leaf
        f, k = best[1]
        left = b[rows, f] <= k
        return f, k, self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1)

    def _apply(self, tree, b: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            out[rows] = tree
            return out
        f, k, left, right = tree
        side = b[rows, f] <= k
        self._apply(left, b, rows[side], out)
        self._apply(right, b, rows[~side], out)
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, total = self._bin(x), np.full(len(x), self.start)
        for tree in self.trees:
            total += self._apply(tree, b, np.arange(len(x)), np.zeros(len(x)))
        return total


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities): the non-decreasing least-squares fit, by pooling adjacent violators; equal scores are one place."""
    places, which, times = np.unique(score, return_inverse=True, return_counts=True)
    means = np.bincount(which, y, len(places)) / times
    values, weights, at = [], [], []
    for s, v, n in zip(places.tolist(), means.tolist(), times.tolist(), strict=True):
        values.append(v)
        weights.append(float(n))
        at.append([s, s])
        while len(values) > 1 and values[-2] >= values[-1]:
            w = weights[-2] + weights[-1]
            values[-2] = (values[-2] * weights[-2] + values[-1] * weights[-1]) / w
            weights[-2] = w
            at[-2][1] = at[-1][1]
            values.pop(), weights.pop(), at.pop()
    xs = np.array([x for span in at for x in span])
    return xs, np.repeat(values, 2)
