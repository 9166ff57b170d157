"""An isolation forest: path lengths over random splits, fitted on a bounded table of rows."""

import math
from dataclasses import dataclass

import numpy as np

_EULER = 0.5772156649015329


def mean_path(n: np.ndarray) -> np.ndarray:
    """The mean path length of an unsuccessful search in a random binary tree over ``n`` rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + _EULER) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class IsolationForest:
    """All trees' nodes in one table; the children of inner node k are ``child[k]`` and ``child[k] + 1``."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    length: np.ndarray  # of a leaf: its depth plus the mean path of the rows it was left with
    scale: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length): towards 1 for rows that few splits set apart."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            live = every
            while len(live):
                inner = self.feature[at[live]] >= 0
                live = live[inner]
                k = at[live]
                at[live] = self.child[k] + (rows[live, self.feature[k]] > self.threshold[k])
            total += self.length[at]
        return np.exp2(-total / len(self.roots) / self.scale)


def fit(rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> IsolationForest:
    """A forest over random samples of ``rows``.

    A split takes a random feature and a random value between the bounds of the
    node's cell; the root's cell is ``low`` to ``high``, the bounds of all training rows, not only
    of the sample, so that a value which no row of the sample has is set apart at once.
    """
    rng = np.random.default_rng(seed)
    sample = min(sample, len(rows))
    depth_most = max(1, math.ceil(math.log2(max(sample, 2)))) + 4
    wide = np.nonzero(high > low)[0]
    feature, threshold, child, length, roots = [], [], [], [], []

    def add() -> int:
        for column, value in ((feature, -1), (threshold, 0.0), (child, -1), (length, 0.0)):
            column.append(value)
        return len(feature) - 1

    for _ in range(trees):
        root = add()
        roots.append(root)
        todo = [(root, rows[rng.choice(len(rows), sample, replace=False)], low.astype(float), high.astype(float), 0)]
        while todo:
            at, own, lo, hi, depth = todo.pop()
            if len(own) <= 1 or depth >= depth_most or not len(wide):
                length[at] = depth + float(mean_path(len(own)))
                continue
            k = int(rng.choice(wide))
            cut = float(rng.uniform(lo[k], hi[k]))
            below = own[:, k] <= cut
            left, right = add(), add()
            feature[at], threshold[at], child[at] = k, cut, left
            lo_right, hi_left = lo.copy(), hi.copy()
            lo_right[k] = hi_left[k] = cut
            todo += [(left, own[below], lo, hi_left, depth + 1), (right, own[~below], lo_right, hi, depth + 1)]
    return IsolationForest(np.array(roots), np.array(feature), np.array(threshold), np.array(child), np.array(length), float(mean_path(sample)) or 1.0)
