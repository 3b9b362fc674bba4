"""Gradient-boosted trees for a yes-or-no label on a bounded table of numbers, fitted with histograms in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32
DEPTH = 4
TREES = 40
RATE = 0.3
LEAST_WEIGHT = 2.0


@dataclass
class Trees:
    """Complete trees of ``DEPTH`` levels: a feature and a threshold per inner node (go right if greater), a value per leaf."""

    start: float
    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of the label per row."""
        total = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        for features, thresholds, values in zip(self.features, self.thresholds, self.values, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[every, features[node]] > thresholds[node])
            total += values[node - ((1 << DEPTH) - 1)]
        return total


def fit(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Trees that minimise logistic loss; equal gains go to the first feature and the lowest threshold."""
    count, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, j], "left") for j, e in enumerate(edges)], 1)
    mean = float(np.clip(labels.mean() if count else 0.5, 1e-3, 1 - 1e-3))
    margin = np.full(count, np.log(mean / (1 - mean)))
    inner = (1 << DEPTH) - 1
    out = Trees(float(np.log(mean / (1 - mean))), np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)))
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = labels - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(count, np.int64)
        for level in range(DEPTH):
            first, nodes = (1 << level) - 1, 1 << level
            local = node - first
            best_gain, best = np.full(nodes, 1e-9), [(0, np.inf)] * nodes
            for j in range(width):
                cell = local * BINS + binned[:, j]
                g = np.cumsum(np.bincount(cell, gradient, nodes * BINS).reshape(nodes, BINS), 1)
                w = np.cumsum(np.bincount(cell, weight, nodes * BINS).reshape(nodes, BINS), 1)
                rest_g, rest_w = g[:, -1:] - g, w[:, -1:] - w
                gain = g ** 2 / (w + 1) + rest_g ** 2 / (rest_w + 1) - g[:, -1:] ** 2 / (w[:, -1:] + 1)
                gain[(w < LEAST_WEIGHT) | (rest_w < LEAST_WEIGHT)] = 0
                gain[:, len(edges[j]):] = 0
                at = gain.argmax(1)
                for n in np.flatnonzero(gain[np.arange(nodes), at] > best_gain):
                    best_gain[n], best[n] = gain[n, at[n]], (j, float(edges[j][at[n]]))
            for n, (j, threshold) in enumerate(best):
                out.features[tree, first + n], out.thresholds[tree, first + n] = j, threshold
            node = 2 * node + 1 + (rows[np.arange(count), out.features[tree, node]] > out.thresholds[tree, node])
        leaf = node - inner
        g, w = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        out.values[tree] = RATE * g / (w + 1)
        margin += out.values[tree][leaf]
    return out
