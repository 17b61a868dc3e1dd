"""Histogram decision trees on the driver, flattened into node arrays.

One grower serves both ensembles: boosting with second-order gains and monotonic
constraints, and a random forest with bootstrap rows and random features.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BINS = 64


class Trees(NamedTuple):
    """All trees in one set of arrays; a leaf points to itself.  ``roots``: first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Base plus the sum of all trees' values: ``depth`` gathers for all rows and trees at once."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                go = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(go, self.left[node], self.right[node])
            out += self.value[node]
        return out


def edges_of(column: np.ndarray) -> np.ndarray:
    """Candidate thresholds of a feature: distinct quantiles, the largest value excluded."""
    q = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
    return q[q < column.max()] if len(column) else q


class _Grower:
    def __init__(self, x: np.ndarray, depth: int, least: int, l2: float, constraints: np.ndarray, features: int, rng: np.random.Generator):
        self.edges = [edges_of(c) for c in x.T]
        self.binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1) if len(x) else np.zeros(x.shape, int)
        self.depth, self.least, self.l2, self.constraints, self.features, self.rng = depth, least, l2, constraints, features, rng

    def grow(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: list, lo: float = -np.inf, hi: float = np.inf, level: int = 0) -> int:
        """Adds the tree of ``rows`` to ``nodes`` and gives its root; leaf values stay within [lo, hi]."""
        at = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + self.l2), lo, hi))
        nodes.append([0, np.inf, at, at, value])
        if level == self.depth or len(rows) < 2 * self.least:
            return at
        best, split = 1e-9, None
        chosen = np.arange(self.binned.shape[1]) if self.features >= self.binned.shape[1] else self.rng.choice(self.binned.shape[1], self.features, replace=False)
        for f in chosen:
            k = len(self.edges[f])
            if not k:
                continue
            b = self.binned[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=k + 1))[:k] for w in (g[rows], h[rows], None))
            wl, wr = np.clip(-gl / (hl + self.l2), lo, hi), np.clip(-(gs - gl) / (hs - hl + self.l2), lo, hi)
            score = lambda w, gg, hh: -(gg * w + 0.5 * (hh + self.l2) * w * w)
            gain = score(wl, gl, hl) + score(wr, gs - gl, hs - hl) - score(value, gs, hs)
            ok = (nl >= self.least) & (len(rows) - nl >= self.least) & (self.constraints[f] * (wr - wl) >= 0)
            gain = np.where(ok, gain, -np.inf)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, split = gain[i], (f, i, wl[i], wr[i])
        if split is None:
            return at
        f, i, wl, wr = split
        go = self.binned[rows, f] <= i
        mid, c = (wl + wr) / 2, self.constraints[f]
        left = self.grow(rows[go], g, h, nodes, mid if c < 0 else lo, mid if c > 0 else hi, level + 1)
        right = self.grow(rows[~go], g, h, nodes, mid if c > 0 else lo, mid if c < 0 else hi, level + 1)
        nodes[at] = [int(f), float(self.edges[f][i]), left, right, 0.0]
        return at


def _flat(nodes: list, roots: list, depth: int, base: float, scale: float) -> Trees:
    f, t, a, b, v = zip(*nodes, strict=True) if nodes else ((), (), (), (), ())
    return Trees(np.array(f, int), np.array(t, float), np.array(a, int), np.array(b, int), np.array(v, float) * scale, np.array(roots, int), depth, base)


def boosted(x: np.ndarray, y: np.ndarray, constraints=None, rounds: int = 60, depth: int = 4, rate: float = 0.15, least: int = 20, l2: float = 1.0) -> Trees:
    """Gradient-boosted trees for the log-odds of ``y``; ``constraints``: -1, 0 or 1 for each feature.

    Without both classes: the constant prior.
    """
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate_1 / (1 - rate_1)))
    if len(np.unique(y)) < 2:
        return _flat([], [], depth, base, rate)
    grower = _Grower(x, depth, least, l2, np.zeros(x.shape[1]) if constraints is None else np.asarray(constraints), x.shape[1], np.random.default_rng(0))
    raw, nodes, roots, rows = np.full(len(y), base), [], [], np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grower.grow(rows, p - y, p * (1 - p), nodes))
        raw += rate * _flat(nodes, roots[-1:], depth, 0.0, 1.0).raw(x)
    return _flat(nodes, roots, depth, base, rate)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 6, least: int = 5, seed: int = 7) -> Trees:
    """A random forest: each leaf holds the share of ``y``; ``raw`` is their mean over trees."""
    rng = np.random.default_rng(seed)
    grower = _Grower(x, depth, least, 1e-6, np.zeros(x.shape[1]), max(1, int(np.ceil(np.sqrt(x.shape[1])))), rng)
    nodes, roots = [], []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        roots.append(grower.grow(rows, -y.astype(float), np.ones(len(y)), nodes))
    return _flat(nodes, roots, depth, 0.0, 1.0 / trees)
