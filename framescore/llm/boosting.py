"""Gradient-boosted trees over dense features and isotonic calibration, for samples that fit on the driver."""

from __future__ import annotations

import numpy as np

TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 40, 3, 0.2, 48, 1.0, 5


class Boosted:
    """Trees fitted to Newton steps of the logistic loss; each is (feature, threshold, left, right) or a leaf's value."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        self.start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        self.trees: list = []
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])  # bin b: up to edge b
        margin = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            self.trees.append(_grown(binned, edges, p - y, p * (1 - p), np.arange(len(y)), depth))
            margin += RATE * _leaves(self.trees[-1], x)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((RATE * _leaves(t, x) for t in self.trees), start=np.full(len(x), self.start))


def _grown(binned: np.ndarray, edges: list, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int):
    g, h = grad[rows], hess[rows]
    leaf = float(-g.sum() / (h.sum() + RIDGE))
    if depth == 0 or len(rows) < 2 * LEAST:
        return leaf
    whole, best = g.sum() ** 2 / (h.sum() + RIDGE), (1e-3, -1, -1)
    for f, e in enumerate(edges):
        b, n = binned[f, rows], len(e) + 1
        gl, hl, nl = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (g, h, None))
        gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - whole
        gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), f, int(gain.argmax()))
    if best[1] < 0:
        return leaf
    left = binned[best[1], rows] <= best[2]
    return best[1], float(edges[best[1]][best[2]]), _grown(binned, edges, grad, hess, rows[left], depth - 1), _grown(binned, edges, grad, hess, rows[~left], depth - 1)


def _leaves(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, left, right = tree
    return np.where(x[:, f] <= t, _leaves(left, x), _leaves(right, x))


class Isotonic:
    """The weighted least-squares rising curve through (x, y), by pooling neighbours that fall; straight between pools."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # weight, sum of weighted x, sum of weighted y
        for a, b, w in zip(x[order], y[order], weight[order], strict=True):
            pools.append([w, w * a, w * b])
            while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
        w, sx, sy = np.array(pools).T
        self.x, self.y = sx / w, sy / w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)
