"""Generalised additive model with pairwise interactions, boosted in numpy.

The model is a sum of lookup tables: one per feature over quantile bins, and one per
chosen pair of features over coarser bins. Boosting goes through the tables in turn; each
step fits a shallow tree to the current residuals over one table's bins and adds a small
part of it to the table. Scoring adds table entries: no tree is left.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

MAIN_BINS, PAIR_BINS, RIDGE = 32, 8, 1.0


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(features), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, features[:, f], side="right")]
        coarse = {}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            for f in (a, b):
                if f not in coarse:
                    coarse[f] = np.searchsorted(self.pair_edges[f], features[:, f], side="right")
            total += table[coarse[a], coarse[b]]
        return sigmoid(total)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Where to cut ordered bins, and what the cut gains (0 where none helps)."""
    if len(g) < 2:
        return 0, 0.0
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    rg, rh = g.sum() - lg, h.sum() - lh
    gain = lg**2 / (lh + RIDGE) + rg**2 / (rh + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(np.argmax(gain))
    return at + 1, float(gain[at])


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + RIDGE))


def _line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over ordered bins, as one value per bin."""
    out = np.full(len(g), _leaf(g, h))
    cut, gain = _best_split(g, h)
    if gain <= 0:
        return out
    sides = [(0, cut), (cut, len(g))]
    deeper = [_best_split(g[a:b], h[a:b]) for a, b in sides]
    best = int(deeper[1][1] > deeper[0][1])
    if deeper[best][1] > 0:
        a, b = sides.pop(best)
        sides += [(a, a + deeper[best][0]), (a + deeper[best][0], b)]
    for a, b in sides:
        out[a:b] = _leaf(g[a:b], h[a:b])
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to four leaves over a grid: one axis is cut, then each side along
    the other axis."""
    cuts = [_best_split(g.sum(1 - axis), h.sum(1 - axis)) for axis in (0, 1)]
    axis = int(cuts[1][1] > cuts[0][1])
    if axis:
        return _grid_tree_rows(g.T, h.T, cuts[1]).T
    return _grid_tree_rows(g, h, cuts[0])


def _grid_tree_rows(g, h, cut: tuple[int, float]) -> np.ndarray:
    out = np.zeros(g.shape)
    for rows in (slice(0, cut[0]), slice(cut[0], None)) if cut[1] > 0 else (slice(None),):
        at, gain = _best_split(g[rows].sum(0), h[rows].sum(0))
        for cols in (slice(0, at), slice(at, None)) if gain > 0 else (slice(None),):
            out[rows, cols] = _leaf(g[rows, cols], h[rows, cols])
    return out


def fit(
    features: np.ndarray, labels: np.ndarray, rounds: int = 120, pair_rounds: int = 40,
    max_pairs: int = 8, rate: float = 0.1,
) -> AdditiveModel:
    """Fit to rows of finite features and labels 0 / 1. Without rows the model says 0.5
    for every text; with one label only, nearly that label."""
    n, width = features.shape
    share = (labels.sum() + 0.5) / (n + 1.0)
    intercept = float(np.log(share / (1 - share)))
    if n == 0 or labels.min() == labels.max():
        return AdditiveModel(intercept, [np.empty(0)] * width, [np.zeros(1)] * width)
    model = AdditiveModel(
        intercept,
        [quantile_edges(features[:, f], MAIN_BINS) for f in range(width)], [],
        [quantile_edges(features[:, f], PAIR_BINS) for f in range(width)],
    )
    fine = [np.searchsorted(e, features[:, f], side="right") for f, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, features[:, f], side="right") for f, e in enumerate(model.pair_edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(n, intercept)
    for _ in range(rounds):
        for f, bins in enumerate(fine):
            p = sigmoid(total)
            size = len(model.tables[f])
            step = rate * _line_tree(
                np.bincount(bins, labels - p, size), np.bincount(bins, p * (1 - p), size)
            )
            model.tables[f] += step
            total += step[bins]
    model.pairs = _strongest_pairs(coarse, model.pair_edges, labels, sigmoid(total), max_pairs)
    shapes = [(len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1) for a, b in model.pairs]
    model.pair_tables = [np.zeros(s) for s in shapes]
    cells = [coarse[a] * s[1] + coarse[b] for (a, b), s in zip(model.pairs, shapes)]
    for _ in range(pair_rounds):
        for k, (cell, shape) in enumerate(zip(cells, shapes)):
            p = sigmoid(total)
            step = rate * _grid_tree(*_grids(cell, shape, labels, p))
            model.pair_tables[k] += step
            total += step.reshape(-1)[cell]
    return model


def _grids(cell, shape, labels, p):
    size = shape[0] * shape[1]
    g = np.bincount(cell, labels - p, size).reshape(shape)
    return g, np.bincount(cell, p * (1 - p), size).reshape(shape)


def _strongest_pairs(coarse, edges, labels, p, most: int) -> list[tuple[int, int]]:
    """The pairs whose grids explain most of what the single features leave."""
    gains = []
    for a in range(len(coarse)):
        for b in range(a + 1, len(coarse)):
            shape = (len(edges[a]) + 1, len(edges[b]) + 1)
            g, h = _grids(coarse[a] * shape[1] + coarse[b], shape, labels, p)
            tree = _grid_tree(g, h)
            gains.append((float((tree * g - 0.5 * tree**2 * h).sum()), a, b))
    gains.sort(key=lambda x: (-x[0], x[1], x[2]))
    return [(a, b) for gain, a, b in gains[:most] if gain > 0]
