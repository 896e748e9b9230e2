"""A small classification tree (binary splits, Gini impurity), grown on a table that fits in memory."""

from __future__ import annotations

import numpy as np


def grow(x: np.ndarray, y: np.ndarray, classes: int, max_depth: int = 16, least: int = 1):
    """Nested tuples (feature, threshold, left, right), leaves are class numbers. Deterministic: the
    first feature and lowest threshold of the greatest gain win; a threshold lies midway."""
    counts = np.bincount(y, minlength=classes)
    best_gain, best = 1e-9, None
    whole = 1 - ((counts / len(y)) ** 2).sum()
    if whole > 0 and max_depth > 0:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            values, labels = x[order, f], y[order]
            left = np.zeros(classes)
            for i in range(len(y) - 1):
                left[labels[i]] += 1
                if values[i] == values[i + 1] or i + 1 < least or len(y) - i - 1 < least:
                    continue
                n, m = i + 1, len(y) - i - 1
                gain = whole - (n * (1 - ((left / n) ** 2).sum()) + m * (1 - (((counts - left) / m) ** 2).sum())) / len(y)
                if gain > best_gain + 1e-12:
                    best_gain, best = gain, (f, (values[i] + values[i + 1]) / 2)
    if best is None:
        return int(counts.argmax())
    f, at = best
    low = x[:, f] <= at
    return (f, at, grow(x[low], y[low], classes, max_depth - 1, least), grow(x[~low], y[~low], classes, max_depth - 1, least))


def classify(tree, row) -> int:
    while not isinstance(tree, int):
        f, at, low, high = tree
        tree = low if row[f] <= at else high
    return tree
