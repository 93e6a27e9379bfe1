"""Gradient-boosted trees for a logistic loss over binned features, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Complete binary trees of one depth: split feature and bound of each inner node, value of each leaf."""

    def __init__(self, feature, bound, value, start, rate):
        self.feature, self.bound, self.value, self.start, self.rate = feature, bound, value, start, rate

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.start)
        for f, b, v in zip(self.feature, self.bound, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
                if 2 * node[0] + 1 > 2 * len(f) if len(node) else True:
                    break
            out += self.rate * v[node - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, least: float = 1.0) -> Trees:
    """Newton boosting with histogram splits at quantiles."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    n, m = x.shape
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    z = np.full(n, start)
    inner = 2**depth - 1
    out = ([], [], [])
    cell = codes + np.arange(m) * BINS
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        g, h = q - y, q * (1 - q) + 1e-6
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            flat = (((node - first) * m * BINS)[:, None] + cell).ravel()
            gs = np.bincount(flat, np.repeat(g, m), width * m * BINS).reshape(width, m, BINS)
            hs = np.bincount(flat, np.repeat(h, m), width * m * BINS).reshape(width, m, BINS)
            gl, hl = np.cumsum(gs, 2), np.cumsum(hs, 2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + least) + (gt - gl) ** 2 / (ht - hl + least) - gt**2 / (ht + least)
            gain[(hl < least) | (ht - hl < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], bound[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > bound[node])
        leaf = node - inner
        value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + least)
        z += rate * value[leaf]
        for o, v in zip(out, (feature, bound, value), strict=True):
            o.append(v)
    return Trees(*out, start, rate)
