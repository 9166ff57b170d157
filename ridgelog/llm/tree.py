"""A small binary decision tree (Gini splits on numeric features), trained on the driver on a labelled table."""

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class DecisionTree:
    """Node k tests ``feature[k] <= threshold[k]`` and goes to ``left[k]`` or ``right[k]``; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """True where more than half of the training rows of the leaf were positive."""
        at = np.zeros(len(rows), np.int64)
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.share[at] > 0.5
            value = rows[np.arange(len(rows)), np.maximum(feature, 0)]
            step = np.where(value <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, step, at)


def _best_split(rows: np.ndarray, labels: np.ndarray, least: int) -> tuple[float, int, float]:
    n, best = len(labels), (0.0, -1, 0.0)
    share = labels.mean()
    base = 2 * share * (1 - share)
    for k in range(rows.shape[1]):
        order = np.argsort(rows[:, k], kind="stable")
        x, positives = rows[order, k], np.cumsum(labels[order])
        cut = np.nonzero(x[1:] > x[:-1])[0] + 1
        cut = cut[(cut >= least) & (n - cut >= least)]
        if not len(cut):
            continue
        p, q = positives[cut - 1] / cut, (positives[-1] - positives[cut - 1]) / (n - cut)
        gain = base - (cut * 2 * p * (1 - p) + (n - cut) * 2 * q * (1 - q)) / n
        at = int(np.argmax(gain))
        if gain[at] > best[0] + 1e-12:
            best = (float(gain[at]), k, float((x[cut[at] - 1] + x[cut[at]]) / 2))
    return best


def train(rows: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 2) -> DecisionTree:
    """The tree of at most ``depth`` tests with at least ``least`` rows in every leaf."""
    nodes: list[list] = []

    def grow(rows, labels, depth):
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(labels.mean())])
        gain, feature, threshold = _best_split(rows, labels.astype(float), least) if depth and 0 < labels.mean() < 1 else (0.0, -1, 0.0)
        if gain > 0:
            below = rows[:, feature] <= threshold
            nodes[at][:2] = feature, threshold
            nodes[at][2] = grow(rows[below], labels[below], depth - 1)
            nodes[at][3] = grow(rows[~below], labels[~below], depth - 1)
        return at

    grow(np.asarray(rows, float), np.asarray(labels, bool), depth)
    return DecisionTree(*(np.array(x) for x in zip(*nodes)))
