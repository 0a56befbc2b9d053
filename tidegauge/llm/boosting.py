"""Gradient-boosted trees for yes or no, fitted on a bounded table of numbers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class BoostSettings:
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    penalty: float = 1.0
    least_weight: float = 1.0  # curvature that either side of a split must hold


@dataclass(frozen=True)
class Tree:
    """A full tree: node i has the children 2 i + 1 and 2 i + 2; values by leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range((len(self.feature) + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return node - len(self.feature)


@dataclass(frozen=True)
class Boosted:
    """Trees whose values add up to a logit."""

    start: float
    trees: list[Tree] = field(default_factory=list)

    def probability(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.start)
        for tree in self.trees:
            logit += tree.value[tree.leaves(x)]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, settings: BoostSettings = BoostSettings()) -> Boosted:
    """Newton boosting of the log loss; labels 0 and 1, splits between quantiles of each feature."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Boosted(start)
    cuts = [np.unique(np.quantile(column, np.arange(1, settings.bins) / settings.bins, method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    logit, trees = np.full(len(y), start), []
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-logit))
        trees.append(_tree(binned, cuts, y - p, p * (1 - p), settings))
        logit = logit + trees[-1].value[trees[-1].leaves(x)]
    return Boosted(start, trees)


def _tree(binned: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, bend: np.ndarray, settings: BoostSettings) -> Tree:
    """One tree by best gain, level by level; a node that gains nothing sends all rows to its left child."""
    n_inner = (1 << settings.depth) - 1
    feature, threshold = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
    node, rows = np.zeros(len(slope), np.int64), np.arange(len(slope))
    cut = np.full(n_inner, settings.bins, np.int64)
    for level in range(settings.depth):
        first, count = (1 << level) - 1, 1 << level
        best = np.full(count, 1e-9)
        for f in range(binned.shape[1]):
            if not len(cuts[f]):
                continue
            cell = (node - first) * settings.bins + binned[:, f]
            g, h = (np.bincount(cell, w, count * settings.bins).reshape(count, -1) for w in (slope, bend))
            left_g, left_h = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
            all_g, all_h = left_g[:, -1:], left_h[:, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            worth = lambda a, b: a * a / (b + settings.penalty)
            gain = worth(left_g, left_h) + worth(right_g, right_h) - worth(all_g, all_h)
            gain[(left_h < settings.least_weight) | (right_h < settings.least_weight)] = -1
            gain = gain[:, : len(cuts[f])]
            at = gain.argmax(axis=1)
            better = np.flatnonzero(gain[np.arange(count), at] > best)
            best[better] = gain[better, at[better]]
            feature[first + better], cut[first + better] = f, at[better]
            threshold[first + better] = cuts[f][at[better]]
        node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
    leaf = node - n_inner
    g, h = (np.bincount(leaf, w, n_inner + 1) for w in (slope, bend))
    return Tree(feature, threshold, settings.rate * g / (h + settings.penalty))
