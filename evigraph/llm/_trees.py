"""Gradient-boosted trees over a small dense matrix, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Logistic boosting of histogram trees; missing values aren't expected."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf value
    depth: int = 3

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        binned = self._bins(x)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0) -> Boosted:
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    edges = [e if len(e) else np.zeros(1) for e in edges]
    prior = np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4)
    model = Boosted(edges, float(np.log(prior / (1 - prior))), [], depth)
    binned = model._bins(x)
    margin, width = np.full(len(x), model.base), max(len(e) for e in edges) + 1
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), np.maximum(w * p * (1 - p), 1e-9)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            low, many = 2**level - 1, 2**level
            local = node - low
            best = np.full(many, 1e-6)
            for f in range(x.shape[1]):
                key = local * width + binned[:, f]
                gs = np.bincount(key, g, many * width).reshape(many, width)
                hs = np.bincount(key, h, many * width).reshape(many, width)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                at = gain[:, :-1].argmax(1) if width > 1 else np.zeros(many, int)
                top = gain[np.arange(many), at]
                better = top > best
                best[better] = top[better]
                feature[low : low + many][better], cut[low : low + many][better] = f, at[better]
            node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cut[node])
        end = node - inner
        leaf = -rate * np.bincount(end, g, 2**depth) / (np.bincount(end, h, 2**depth) + ridge)
        model.trees.append((feature, cut, leaf))
        margin += leaf[end]
    return model


def fit_isotonic(margin: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float, strength: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best nondecreasing map from margin to probability (pool adjacent violators).

    Each pool is drawn to the prior as by so many more rows, so that a few rows
    never make a sure score.
    """
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # weight, mean label, mean margin
    for m, t, v in zip(margin[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        blocks.append([v, t, m])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            v1, t1, m1 = blocks.pop()
            v0, t0, m0 = blocks.pop()
            v2 = v0 + v1
            blocks.append([v2, (v0 * t0 + v1 * t1) / v2, (v0 * m0 + v1 * m1) / v2])
    weight, mean = np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])
    drawn = (weight * mean + strength * prior) / (weight + strength)
    return np.array([b[2] for b in blocks]), np.clip(np.maximum.accumulate(drawn), 0, 1)
