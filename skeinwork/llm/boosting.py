"""Gradient-boosted trees and isotonic calibration on small dense samples.

The sample a classifier is fitted on is bounded (see ``abuse.MAX_SAMPLES``), so fitting needs no
cluster; scoring is vectorised and runs inside the tasks that compute the features.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


#: Bins of a feature among which a tree looks for its cut.
BINS = 64


def bins_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each value, cuts between the bins; infinite where a feature has fewer): a bin for each distinct
    value, or for each quantile of a feature with more of them."""
    binned, cuts = np.zeros(x.shape, dtype=np.int64), np.full((x.shape[1], BINS - 1), np.inf)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)))
        middle = (values[1:] + values[:-1]) / 2
        cuts[f, : len(middle)] = middle
        binned[:, f] = np.searchsorted(middle, x[:, f], side="left")
    return binned, cuts


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)  # -1 at a leaf
    cut: list[float] = field(default_factory=list)
    child: list[tuple[int, int]] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        feature, cut, value = np.array(self.feature), np.array(self.cut), np.array(self.value)
        child = np.array(self.child, dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return value[at]
            r, n = rows[inner], at[inner]
            at[inner] = child[n, (x[r, feature[n]] > cut[n]).astype(np.int64)]


@dataclass
class Boosted:
    """Logistic boosting: second-order gains, shrinkage, row sampling by a fixed seed."""

    trees: int = 80
    depth: int = 2
    rate: float = 0.1
    leaf: int = 8
    ridge: float = 4.0
    share: float = 0.8
    seed: int = 11
    base: float = 0.0
    grown: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rng = np.random.default_rng(self.seed)
        p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base, self.grown = float(np.log(p / (1 - p))), []
        score = np.full(len(y), self.base)
        binned, cuts = bins_of(x)
        for _ in range(self.trees if len(y) else 0):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, q * (1 - q)
            rows = np.flatnonzero(rng.random(len(y)) < self.share)
            if len(rows) < 2 * self.leaf:
                continue
            tree = Tree()
            self._grow(tree, binned, cuts, g, h, rows, 0)
            self.grown.append(tree)
            score += tree.predict(x)
        return self

    def _grow(self, tree: Tree, binned, cuts, g, h, rows, level: int) -> int:
        """A node from histograms of the gradients: one pass over the rows for all features."""
        node = len(tree.feature)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        tree.feature.append(-1), tree.cut.append(0.0), tree.child.append((0, 0))
        tree.value.append(float(-self.rate * total_g / (total_h + self.ridge)))
        if level == self.depth or len(rows) < 2 * self.leaf:
            return node
        width = binned.shape[1]
        at = (binned[rows] + np.arange(width) * BINS).ravel()
        sums = [np.bincount(at, weights=w, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)[:, :-1] for w in (np.repeat(g[rows], width), np.repeat(h[rows], width), None)]
        left_g, left_h, size = sums
        gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
        gain[(size < self.leaf) | (len(rows) - size < self.leaf) | ~np.isfinite(cuts)] = -1
        f, i = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[f, i] <= 1e-6:
            return node
        tree.feature[node], tree.cut[node] = int(f), float(cuts[f, i])
        goes = binned[rows, f] > i
        low = self._grow(tree, binned, cuts, g, h, rows[~goes], level + 1)
        high = self._grow(tree, binned, cuts, g, h, rows[goes], level + 1)
        tree.child[node] = (low, high)
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.grown), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing fit, by pooling adjacent violators.

    A pooled block is one knot at its mean score, and its probability is smoothed by one case of each
    kind, so that between the blocks, and for small ones, the fit is no step function of few values.
    """
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, t in zip(score[order], y[order]):
        blocks.append([float(t), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    x = np.array([s / n for _, n, s in blocks])
    p = np.maximum.accumulate(np.array([(t + 1) / (n + 2) if 0 < t < n else (t + 0.5) / (n + 1) for t, n, _ in blocks]))
    return x, p


@dataclass
class Calibrated:
    """Boosted trees with isotonic calibration on scores of folds that were left out."""

    model: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, folds: int = 5, repeats: int = 3, **options) -> Calibrated:
        model = Boosted(**options).fit(x, y)
        if len(y) < 4 * folds or y.min() == y.max():
            return cls(model, (np.array([-1e9, 1e9]), np.full(2, y.mean() if len(y) else 0.0)))
        rng, scores = np.random.default_rng(3), []
        for _ in range(repeats):
            fold, out = rng.permutation(len(y)) % folds, np.zeros(len(y))
            for k in range(folds):
                out[fold == k] = Boosted(**options).fit(x[fold != k], y[fold != k]).score(x[fold == k])
            scores.append(out)
        return cls(model, isotonic(np.concatenate(scores), np.tile(y, repeats)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; beyond the outer knots a twentieth of what is left keeps the order of scores."""
        score, (knots, p) = self.model.score(x), self.knots
        inner = np.interp(score, knots, p)
        over, under = np.maximum(0.0, score - knots[-1]), np.maximum(0.0, knots[0] - score)
        return inner + (1 - inner) * 0.05 * (1 - np.exp(-over)) - inner * 0.05 * (1 - np.exp(-under))
