"""Gradient-boosted trees for small feature tables, on histograms of feature bins."""

from __future__ import annotations

import numpy as np


class Trees:
    """A binary classifier: trees of equal depth over binned features."""

    def __init__(self, edges: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], base: float, depth: int):
        self.edges, self.trees, self.base, self.depth = edges, trees, base, depth

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def logit(self, x: np.ndarray) -> np.ndarray:
        binned, out = self.bins(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, shrink: float = 1.0) -> Trees:
    """Second-order boosting of the log loss."""
    edges = []
    for i in range(x.shape[1]):
        values = np.unique(x[:, i])
        edges.append((values[1:] + values[:-1]) / 2 if len(values) <= bins else np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, [], float(np.log(share / (1 - share))), depth)
    binned = model.bins(x)
    width, nodes = bins + 1, 2**depth - 1
    logit = np.full(len(x), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p) + 1e-6
        feature, cut, at = np.zeros(nodes, np.int64), np.full(nodes, width, np.int64), np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-6)
            for f in range(x.shape[1]):
                place = (at - first) * width + binned[:, f]
                left_g = np.bincount(place, g, many * width).reshape(many, width).cumsum(1)
                left_h = np.bincount(place, h, many * width).reshape(many, width).cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + shrink) + (all_g - left_g) ** 2 / (all_h - left_h + shrink) - all_g**2 / (all_h + shrink)
                where = gain.argmax(1)
                top = gain[np.arange(many), where]
                better = top > best
                best[better] = top[better]
                feature[first : first + many][better] = f
                cut[first : first + many][better] = where[better]
            at = 2 * at + 1 + (binned[np.arange(len(x)), feature[at]] > cut[at])
        at -= nodes
        leaf = -rate * np.bincount(at, g, nodes + 1) / (np.bincount(at, h, nodes + 1) + shrink)
        logit += leaf[at]
        model.trees.append((feature, cut, leaf))
    return model
