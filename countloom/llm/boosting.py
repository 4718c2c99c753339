"""Gradient-boosted regression trees for a binary target, on binned features."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete trees of one depth: split features and thresholds by level order, leaf values, and a base value."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 24, smooth: float = 2.0, least: int = 8) -> Trees:
    """Newton boosting of the logistic loss; every level splits all nodes by the best of the binned thresholds."""
    if not len(x) or y.min() == y.max():
        base = 0.0 if not len(x) else (4.0 if y[0] else -4.0)
        return Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)), base)
    edges, columns = [], []
    for j in range(x.shape[1]):
        cut = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
        values = np.unique(x[:, j])
        if len(values) <= bins:
            cut = (values[1:] + values[:-1]) / 2
        edges.append(cut)
        columns.append(np.searchsorted(cut, x[:, j], side="left").astype(np.int64))
    wide = bins + 1
    used = np.array([j for j in range(x.shape[1]) if len(edges[j])])
    usable = np.array([np.arange(wide) < len(e) for e in edges])
    columns = np.stack(columns, axis=1)
    blocks = [used[k : k + 16] for k in range(0, len(used), 16)]
    ones = np.ones(len(x))
    base = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(len(x), base)
    all_feature, all_threshold, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            slot = at - first
            best = np.zeros(nodes)
            sum_g, sum_h = np.bincount(slot, g, nodes), np.bincount(slot, h, nodes)
            split = np.full((nodes, 2), -1)
            for some in blocks:  # all features of a block at once
                key = (slot[:, None] * len(some) + np.arange(len(some))) * wide + columns[:, some]
                shape = (nodes, len(some), wide)
                flat = key.ravel()
                gs, hs, ns = (np.bincount(flat, np.repeat(w, len(some)), nodes * len(some) * wide).reshape(shape).cumsum(2) for w in (g, h, ones))
                rg, rh, rn = gs[:, :, -1:] - gs, hs[:, :, -1:] - hs, ns[:, :, -1:] - ns
                gain = gs**2 / (hs + smooth) + rg**2 / (rh + smooth) - (sum_g**2 / (sum_h + smooth))[:, None, None]
                gain[(ns < least) | (rn < least) | ~usable[some]] = 0
                flat_gain = gain.reshape(nodes, -1)
                k = flat_gain.argmax(1)
                better = flat_gain[np.arange(nodes), k] > best + 1e-9
                best[better] = flat_gain[np.arange(nodes), k][better]
                split[better, 0], split[better, 1] = some[k[better] // wide], k[better] % wide
            for s in range(nodes):
                if split[s, 0] >= 0:
                    feature[first + s], threshold[first + s] = split[s, 0], edges[split[s, 0]][split[s, 1]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        slot = at - (2**depth - 1)
        leaf = rate * np.bincount(slot, g, 2**depth) / (np.bincount(slot, h, 2**depth) + smooth)
        f += leaf[slot]
        all_feature.append(feature)
        all_threshold.append(threshold)
        all_leaf.append(leaf)
    return Trees(np.array(all_feature), np.array(all_threshold), np.array(all_leaf), base)
