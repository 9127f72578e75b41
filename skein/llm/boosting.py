"""Gradient-boosted trees for small tables of features, with calibrated probabilities, in numpy.

The training rows are a bounded sample on the driver; a trained model is a few kilobytes and goes to the tasks by closure.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class BoostedTrees:
    """Binary classifier: logistic loss, second-order leaf values, histogram splits over quantile bins.

    Trees are complete with ``depth`` levels, so that a prediction is ``depth`` table look-ups. Ties of gain go to the
    first feature and the lowest cut; equal data give equal models.
    """

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least = rounds, depth, rate, bins, penalty, least
        self.base, self.slope, self.offset, self.threshold = 0.0, 1.0, 0.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        width = self.bins
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        nodes = 2**self.depth - 1
        self.feature = np.zeros((self.rounds, nodes), np.int32)
        self.cut = np.full((self.rounds, nodes), np.inf)
        self.leaf = np.zeros((self.rounds, nodes + 1))
        for t in range(self.rounds):
            p = sigmoid(score)
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                count = 2**level
                gain_best = np.zeros(count)
                pick, cut_bin = np.zeros(count, np.int64), np.full(count, width)
                for j in range(f):
                    key = node * width + np.minimum(binned[:, j], width - 1)
                    sg = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                    sh = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                    ag, ah = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + self.penalty) + (ag - sg) ** 2 / (ah - sh + self.penalty) - ag**2 / (ah + self.penalty)
                    gain[(sh < self.least) | (ah - sh < self.least)] = 0
                    k = gain.argmax(1)
                    best = gain[np.arange(count), k]
                    better = best > gain_best + 1e-9
                    gain_best[better], pick[better], cut_bin[better] = best[better], j, k[better]
                first = 2**level - 1
                for i in range(count):
                    self.feature[t, first + i] = pick[i]
                    if cut_bin[i] < len(self.cuts[pick[i]]):
                        self.cut[t, first + i] = self.cuts[pick[i]][cut_bin[i]]
                right = x[np.arange(n), self.feature[t, first + node]] > self.cut[t, first + node]
                node = node * 2 + right
            sums_g, sums_h = np.bincount(node, g, nodes + 1), np.bincount(node, h, nodes + 1)
            self.leaf[t] = -self.rate * sums_g / (sums_h + self.penalty)
            score += self.leaf[t][node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            total += self.leaf[t][node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.score(x) + self.offset)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fit the slope and offset of the probability on held-out rows, and the threshold of the best F1 there."""
        s = self.score(x)
        design = np.stack([s, np.ones(len(s))], 1)
        w = np.array([1.0, 0.0])
        for _ in range(25):
            p = sigmoid(design @ w)
            grad = design.T @ (p - y) + 1e-3 * (w - [1.0, 0.0])
            hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            w = w - np.linalg.solve(hess, grad)
        self.slope, self.offset = map(float, w)
        p = self.probability(x)
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
        k = int(f1.argmax()) if len(y) else 0
        below = p[order][k + 1] if k + 1 < len(y) else 0.0
        # half-way to the next lower probability, but never beyond an even chance
        self.threshold = float(min(0.5, (p[order][k] + below) / 2)) if len(y) else 0.5
        return self
