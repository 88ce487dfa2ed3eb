"""What the two vector indexes share: usable vectors, samples and clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column | str) -> Column:
    """Whether a vector takes part: not null, all components finite, not all zero."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    big = F.lit(float("inf"))
    odd = F.exists(
        vec, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == big), F.lit(True))
    )
    return F.coalesce(~odd & F.exists(vec, lambda x: x != 0), F.lit(False))


def stacked(vectors, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors count as filled with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def sample(vectors: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` vectors by a hash of ``key``, never more than twice as
    many."""
    place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000))
    return vectors.where(place < 1_000_000 * min(1.0, rows / max(1, total))).limit(2 * rows)


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    d = (x**2).sum(1)[:, None] - 2 * (x @ centers.T) + (centers**2).sum(1)[None, :]
    return np.maximum(d, 0)


def nearest(x: np.ndarray, centers: np.ndarray, step: int = 4096) -> np.ndarray:
    parts = [
        squared_distances(x[i : i + step], centers).argmin(1) for i in range(0, len(x), step)
    ]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def cluster(
    x: np.ndarray, k: int, rounds: int = 10, seed: int = 5, balanced: bool = False
) -> np.ndarray:
    """Up to ``k`` centers of the rows of ``x`` (Lloyd). ``balanced`` moves the centers of
    the smallest clusters next to those of clusters above twice the mean size."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x if len(x) else np.zeros((1, x.shape[1]))
    centers = x[rng.choice(len(x), k, replace=False)]
    for turn in range(rounds):
        own = nearest(x, centers)
        size = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        some = np.flatnonzero(size)
        centers[some] = np.add.reduceat(x[order], starts[some]) / size[some, None]
        if balanced and turn < rounds - 2:
            large = np.flatnonzero(size > 2 * len(x) / k)
            for a, b in zip(large, np.argsort(size, kind="stable")[: len(large)]):
                members = x[own == a]
                centers[b] = members[rng.integers(len(members))]
        empty = np.flatnonzero(size == 0)
        centers[empty] = x[rng.choice(len(x), len(empty), replace=False)]
    return centers
