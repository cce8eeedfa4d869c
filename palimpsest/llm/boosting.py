"""Small gradient-boosted trees on byte features: logistic loss, histogram splits, a sample of the rows for each tree."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0, sample: float = 0.5):
        self.trees, self.depth, self.rate, self.l2, self.sample = trees, depth, rate, l2, sample
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        rng = np.random.default_rng(1)
        self.used = [f for f in range(x.shape[1]) if len(x) and x[:, f].min() != x[:, f].max()]
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            some = np.flatnonzero(rng.random(len(y)) < self.sample) if len(y) > 1000 else np.arange(len(y))
            tree = self._tree(x[some], (y - q)[some], (q * (1 - q))[some])
            self.nodes.append(tree)
            score += self._values(tree, x)
        return self

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A tree, level by level: the histograms of all nodes of a level come from one count for each feature."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.uint8), np.zeros(size)
        at = np.zeros(len(g), np.int64)
        value[0] = self.rate * g.sum() / (h.sum() + self.l2)
        for level in range(self.depth):
            if not len(g) or not self.used:
                break
            first, k = 2**level - 1, 2**level
            base = (at - first) * 32
            cg, ch = np.empty((len(self.used), k, 32)), np.empty((len(self.used), k, 32))
            for j, f in enumerate(self.used):
                key = base + x[:, f]
                cg[j] = np.bincount(key, g, k * 32).reshape(k, 32)
                ch[j] = np.bincount(key, h, k * 32).reshape(k, 32)
            cg, ch = cg.cumsum(2), ch.cumsum(2)
            sg, sh = cg[:1, :, -1:], ch[:1, :, -1:]
            cg, ch = cg[..., :-1], ch[..., :-1]
            gain = cg**2 / (ch + self.l2) + (sg - cg) ** 2 / (sh - ch + self.l2) - sg**2 / (sh + self.l2)
            gain[(ch < 1e-9) | (sh - ch < 1e-9)] = 0
            gain = gain.transpose(1, 0, 2).reshape(k, -1)
            best = gain.argmax(axis=1)
            for n in np.flatnonzero(gain[np.arange(k), best] > 1e-6):
                j, c = divmod(int(best[n]), 31)
                feature[first + n], cut[first + n] = self.used[j], c
                left = cg[j, n, c], ch[j, n, c]
                for side, (a, b) in enumerate((left, (sg[0, n, 0] - left[0], sh[0, n, 0] - left[1]))):
                    value[2 * (first + n) + 1 + side] = self.rate * a / (b + self.l2)
            # rows of a leaf are done
            keep = feature[at] >= 0
            x, g, h, at = x[keep], g[keep], h[keep], at[keep]
            at = 2 * at + 1 + (x[np.arange(len(at)), feature[at]] > cut[at])
        return feature, cut, value

    def _values(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.nodes:
            score += self._values(tree, x)
        return 1 / (1 + np.exp(-score))


def best_threshold(p: np.ndarray, y: np.ndarray, beta: float = 1.0) -> float:
    """The cut of the calibration rows with the best F score, in which recall weighs ``beta`` times precision; halfway to the next lower score."""
    if not y.any():
        return 0.5
    order = np.argsort(-p)
    hit = np.cumsum(y[order])
    f1 = (1 + beta**2) * hit / (np.arange(1, len(p) + 1) + beta**2 * y.sum())
    # only between different scores
    ends = np.r_[p[order][1:] != p[order][:-1], True]
    k = int(np.argmax(np.where(ends, f1, 0)))
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + low) / 2)
