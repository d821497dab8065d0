"""Small gradient boosting of shallow trees for binary labels, on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 16


def _grow(binned, grad, hess, depth, ridge=1.0):
    """A tree as a nested tuple (feature, bin, left, right) with leaf values."""
    if depth == 0 or len(grad) < 20:
        return float(-grad.sum() / (hess.sum() + ridge))
    total = grad.sum() ** 2 / (hess.sum() + ridge)
    best = (1e-6, None, None)
    for j in range(binned.shape[1]):
        g = np.cumsum(np.bincount(binned[:, j], grad, BINS))[:-1]
        h = np.cumsum(np.bincount(binned[:, j], hess, BINS))[:-1]
        gain = g**2 / (h + ridge) + (grad.sum() - g) ** 2 / (hess.sum() - h + ridge) - total
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k)
    _, j, k = best
    if j is None:
        return float(-grad.sum() / (hess.sum() + ridge))
    left = binned[:, j] <= k
    if left.all() or not left.any():
        return float(-grad.sum() / (hess.sum() + ridge))
    return (j, k, *(_grow(binned[x], grad[x], hess[x], depth - 1, ridge) for x in (left, ~left)))


def _walk(tree, binned):
    if not isinstance(tree, tuple):
        return np.full(len(binned), tree)
    j, k, left, right = tree
    return np.where(binned[:, j] <= k, _walk(left, binned), _walk(right, binned))


@dataclass
class Boosted:
    """Boosted trees; ``odds`` gives log odds of rows of features."""

    cuts: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    start: float = 0.0
    rate: float = 0.2

    def fit(self, rows: np.ndarray, labels: np.ndarray, rounds: int = 40, depth: int = 3) -> "Boosted":
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(share / (1 - share)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
        binned, odds = self._bin(rows), np.full(len(rows), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-odds))
            tree = _grow(binned, p - labels, p * (1 - p), depth)
            self.trees.append(tree)
            odds = odds + self.rate * _walk(tree, binned)
        return self

    def _bin(self, rows):
        return np.stack([np.searchsorted(c, x, side="left") for c, x in zip(self.cuts, rows.T)], axis=1)

    def odds(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.empty(0)
        binned = self._bin(rows)
        return self.start + self.rate * sum((_walk(t, binned) for t in self.trees), np.zeros(len(rows)))
