"""Boosted regression trees for one group of rows: arrays in, predictions out.

Every period has models of its own, so fitting is a grouped kernel: periods side by side, one pass over binned
features for each level of each tree. Trees are grown level by level from histograms of weighted sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """How a tree may grow: depth, least rows of a node, ridge on leaf values, one split a level for all nodes,
    leaves at most (the weakest splits of the last level go first)."""

    depth: int = 4
    least: int = 1
    ridge: float = 0.0
    symmetric: bool = False
    leaves: int | None = None


@dataclass
class Tree:
    """Nodes of all levels in heap order without the leaves: a row goes right where its bin is above the cut."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaf(self, binned: np.ndarray) -> np.ndarray:
        rows, at, first = np.arange(len(binned)), np.zeros(len(binned), np.int64), 0
        while first < len(self.feature):
            node = first + at
            at = 2 * at + (binned[rows, self.feature[node]] > self.cut[node])
            first = 2 * first + 1
        return at

    def __call__(self, binned: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(binned)]


def cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner bin edges of each column: its distinct values if few, else quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, column) for e, column in zip(edges, x.T)], axis=1)


def grow(b: np.ndarray, y: np.ndarray, w: np.ndarray, shape: Shape) -> Tree:
    """One tree of weighted least squares on binned rows; rows of weight 0 don't count."""
    n, k = b.shape
    width = int(b.max(initial=0)) + 1
    at, feature, cut = np.zeros(n, np.int64), [], []
    seen = (w > 0).astype(float)

    def gain_of(total: np.ndarray, mass: np.ndarray) -> np.ndarray:
        return total * total / np.maximum(mass + shape.ridge, 1e-300)

    for level in range(shape.depth):
        nodes = 1 << level
        cell = ((np.arange(k) * nodes)[None, :] + at[:, None]) * width + b
        size = k * nodes * width
        s, m, c = (np.bincount(cell.ravel(), np.repeat(v, k), size).reshape(k, nodes, width).cumsum(axis=2) for v in (w * y, w, seen))
        gain = gain_of(s, m) + gain_of(s[..., -1:] - s, m[..., -1:] - m) - gain_of(s[..., -1:], m[..., -1:])
        fits = (c >= max(1, shape.least)) & (c[..., -1:] - c >= max(1, shape.least))
        if shape.symmetric:
            total = np.where(fits, gain, 0.0).sum(axis=1)
            best = np.full(nodes, total.argmax())
            worth = np.full(nodes, total.max())
        else:
            flat = np.where(fits, gain, -np.inf).transpose(1, 0, 2).reshape(nodes, -1)
            best = flat.argmax(axis=1)
            worth = flat[np.arange(nodes), best]
            over = 2 * nodes - (shape.leaves or 2 * nodes)
            if level == shape.depth - 1 and over > 0:
                worth[np.argsort(worth, kind="stable")[:over]] = 0.0
        split = worth > 1e-12
        column, place = best // width, np.where(split, best % width, width)
        feature.append(column)
        cut.append(place)
        at = 2 * at + (b[np.arange(n), column[at]] > place[at])
    leaves = 1 << shape.depth
    mass = np.bincount(at, w, leaves)
    value = np.bincount(at, w * y, leaves) / np.maximum(mass + shape.ridge, 1e-300)
    return Tree(np.concatenate(feature), np.concatenate(cut), value)


def gradient_boosted(x: np.ndarray, y: np.ndarray, w: np.ndarray, every: np.ndarray, rounds: int, rate: float, shape: Shape, subsample: float, columns: float, bins: int, seed: int) -> np.ndarray:
    """Predictions for the rows of ``every`` of trees fitted in turn to what is left of y."""
    rng = np.random.default_rng(seed)
    edges = cuts(x, bins)
    b, b_every = binned(x, edges), binned(every, edges)
    start = np.average(y, weights=w)
    fitted, out = np.full(len(y), start), np.full(len(every), start)
    for _ in range(rounds):
        drawn = w * (rng.random(len(y)) < subsample) if subsample < 1 else w
        chosen = np.sort(rng.permutation(x.shape[1])[: max(1, round(columns * x.shape[1]))])
        tree = grow(b[:, chosen], y - fitted, drawn, shape)
        tree.feature = chosen[tree.feature]
        fitted += rate * tree(b)
        out += rate * tree(b_every)
    return out


def adaptive_boosted(x: np.ndarray, y: np.ndarray, w: np.ndarray, every: np.ndarray, rounds: int, rate: float, shape: Shape, bins: int) -> np.ndarray:
    """Adaptive boosting with linear loss: rows with large errors weigh more in the next tree, and the prediction
    is the weighted median of the trees."""
    edges = cuts(x, bins)
    b, b_every = binned(x, edges), binned(every, edges)
    w = w / w.sum()
    votes, strength = [], []
    for _ in range(rounds):
        tree = grow(b, y, w, shape)
        error = np.abs(tree(b) - y)
        loss = error / error.max() if error.max() > 0 else error
        mean = float(w @ loss)
        if mean >= 0.5 and votes:
            break
        odds = max(mean, 1e-12) / (1 - min(mean, 1 - 1e-12))
        votes.append(tree(b_every))
        strength.append(max(-np.log(odds), 1e-12) * rate)
        if mean <= 0 or mean >= 0.5:
            break
        w = w * odds ** (rate * (1 - loss))
        w = w / w.sum()
    given, strength = np.stack(votes, axis=1), np.array(strength)
    order = np.argsort(given, axis=1, kind="stable")
    half = np.cumsum(strength[order], axis=1) >= 0.5 * strength.sum()
    middle = order[np.arange(len(given)), half.argmax(axis=1)]
    return given[np.arange(len(given)), middle]
