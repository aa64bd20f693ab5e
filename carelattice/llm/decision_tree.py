"""A small classification tree on numeric features."""

from __future__ import annotations

import numpy as np


def grow(features: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 1):
    """(feature, threshold, low, high) for a split by Gini impurity, or the share of label 1."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0) or len(labels) < 2 * least:
        return share
    best = None
    for feature in range(features.shape[1]):
        order = np.argsort(features[:, feature], kind="stable")
        values, ones = features[order, feature], np.cumsum(labels[order])
        for cut in np.flatnonzero(values[1:] > values[:-1]) + 1:
            if cut < least or len(values) - cut < least:
                continue
            low, high = ones[cut - 1] / cut, (ones[-1] - ones[cut - 1]) / (len(values) - cut)
            impurity = cut * low * (1 - low) + (len(values) - cut) * high * (1 - high)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, feature, float(values[cut - 1] + values[cut]) / 2
    if best is None:
        return share
    _, feature, threshold = best
    low = features[:, feature] <= threshold
    return (
        feature, threshold, grow(features[low], labels[low], depth - 1, least),
        grow(features[~low], labels[~low], depth - 1, least),
    )


def share_of_one(tree, row) -> float:
    while isinstance(tree, tuple):
        feature, threshold, low, high = tree
        tree = low if row[feature] <= threshold else high
    return tree
