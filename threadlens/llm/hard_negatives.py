"""Hard negatives: for every anchor and each of its best positives the best rows of other
labels whose score lies in a window below the positive's.

Scores are made in blocks of anchors and rows. What a block cannot send to the result
stays there: of the positives only a block's best, of the other rows only the best of
each window. The pairs that are left get the key (anchor, score descending, positives
first, id) and are shuffled by anchor and sorted by that key within partitions, the
DataFrame form of a secondary sort. One pass over a partition then sees an anchor's pairs
from the best score down: a positive opens a window, a row of another label is given to
every open window that it lies in, and a window with enough rows is closed. The pass
holds the open windows of one anchor, never its pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.session import cut_lineage

BLOCK_ROWS = 8_192  # rows, and anchors, of a block
SCORED_AT_ONCE = 256  # anchors of a block scored together
MOST = 1 << 27  # components are held to this, so that scores fit a long

_PAIR = "anchor long, score long, vec_id long, row long"


def whole_vectors(
    vectors: DataFrame, scale: int, vec_id: str = "vec_id", label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """(row, vec_id, label, vector) with components floor(scale * x) as whole numbers.

    Rows with a null id, label or vector or with a null, NaN or infinite component are
    left out. Components beyond 2^27 either way are held to it."""
    x = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    held = lambda v: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), v))
    sound = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad
    return vectors.where(sound).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).alias("label"),
        F.transform(vector, lambda v: held(F.floor(x(v) * scale).cast("double")).cast("int")).alias("vector"),
    )


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one is filled up with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _scores(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Exact scores of some anchors at a time with all rows: (first anchor, scores)."""
    width = max(max(map(len, x["vector"]), default=0) for x in (anchors, rows))
    a, b = _matrix(anchors["vector"], width), _matrix(rows["vector"], width).T
    top = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * max(width, 1)
    exact = top < 2**53  # sums of whole doubles below this have no rounding
    b = np.ascontiguousarray(b if exact else b.astype(np.int64))
    for at in range(0, len(a), SCORED_AT_ONCE):
        part = a[at : at + SCORED_AT_ONCE]
        yield at, (part @ b).astype(np.int64) if exact else part.astype(np.int64) @ b


def _pairs(anchors, rows, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Pairs (anchor, score, vec_id, row) from (place of the anchor, places, scores)."""
    who = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
    which = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
    scores = np.concatenate([f[2] for f in found]) if found else np.empty(0, np.int64)
    return pd.DataFrame(
        {"anchor": anchors["row"].to_numpy()[who], "score": scores.astype(np.int64),
         "vec_id": rows["vec_id"].to_numpy()[which], "row": rows["row"].to_numpy()[which]}
    )


def _best_positives(count: int):
    """The ``count`` best rows of a block for each of its anchors of the same label."""

    def best(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_pairs(anchors, rows, [])]
        of_label = dict(tuple(rows.groupby("label")))
        for label, some in anchors.groupby("label"):
            if label not in of_label:
                continue
            same = of_label[label].sort_values(["vec_id", "row"], ignore_index=True)
            number, found = same["row"].to_numpy(), []
            for at, scores in _scores(some, same):
                for i, own in enumerate(scores, at):
                    ok = number != some["row"].iloc[i]
                    if ok.sum() > count:  # all that tie with the last one are looked at
                        ok &= own >= -np.partition(-own[ok], count - 1)[count - 1]
                    place = np.flatnonzero(ok)
                    place = place[np.argsort(-own[place], kind="stable")][:count]
                    found.append((i, place, own[place]))
            parts.append(_pairs(some, same, found))
        return pd.concat(parts, ignore_index=True)

    return best


def _window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * positive <= 100 s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _best_negatives(count: int, low: int, high: int):
    """The ``count`` best rows of a block in each window of each anchor; a row in several
    windows comes once."""

    def best(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["vec_id", "row"], ignore_index=True)
        labels, found = rows["label"].to_numpy(), []
        if len(rows) and len(anchors):
            for at, scores in _scores(anchors, rows):
                for i, own in enumerate(scores, at):
                    windows = [_window(int(p), low, high) for p in anchors["positives"].iloc[i]]
                    inside = (own >= min(w[0] for w in windows)) & (own <= max(w[1] for w in windows))
                    place = np.flatnonzero(inside & (labels != anchors["label"].iloc[i]))
                    place = place[np.argsort(-own[place], kind="stable")]
                    falling = -own[place]
                    picks = set()
                    for bottom, top in windows:
                        first = np.searchsorted(falling, -top, "left")
                        last = np.searchsorted(falling, -bottom, "right")
                        picks.update(range(first, min(last, first + count)))
                    place = place[sorted(picks)]
                    found.append((i, place, own[place]))
        return _pairs(anchors, rows, found)

    return best


def _stream(count: int, low: int, high: int):
    """One pass over pairs sorted by (anchor, score descending, positives first, id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, windows = None, []  # open windows: [bottom, top, given, positive, its score]
        for batch in batches:
            out = []
            for anchor, anchor_id, score, positive, vec_id in zip(
                *(batch[c] for c in ("anchor", "anchor_id", "score", "positive", "vec_id"))
            ):
                if anchor != current:
                    current, windows = anchor, []
                if positive:
                    windows.append([*_window(int(score), low, high), 0, vec_id, score])
                    continue
                windows = [w for w in windows if w[0] <= score and w[2] < count]
                for w in windows:
                    if score <= w[1]:
                        w[2] += 1
                        out.append((anchor_id, w[3], w[2], vec_id, w[4], score))
            yield pd.DataFrame(
                out, columns=["anchor_id", "positive_id", "rank", "negative_id",
                              "positive_score", "negative_score"],
            )

    return run


def _dealt(rows: DataFrame, blocks: Column, name: str) -> Column:
    """The block of a row, by a hash of its number."""
    return F.pmod(F.xxhash64(F.lit(name), "row"), blocks).cast("int")


def _copies(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50,
    high: int = 95, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` are those of ``whole_vectors``. A score is the inner product of two vectors, a
    shorter one filled up with zeros; higher ones come first, ties by the smaller vec_id.
    The rows that ``is_anchor`` takes are anchors; an anchor's positives are its
    ``positives`` best other rows of the same label. Each anchor and positive gets the
    ``negatives`` best rows of other labels with
    ``low * positive <= 100 * negative <= high * positive`` (all, if fewer), ranked from 1.

    Rows that repeat an id are different rows, told apart by number: each may be anchor,
    positive and negative. Empty vectors score 0. Without rows, anchors or fitting rows
    the result is empty; a negative positive score leaves no room for a window."""
    rows = cut_lineage(rows)
    anchors = rows.where(is_anchor)
    best = cut_lineage(_positives(rows, anchors, positives, block_rows))
    pairs = _negatives(rows, anchors, best, negatives, low, high, block_rows)
    found = best.withColumn("positive", F.lit(True)).unionByName(
        pairs.withColumn("positive", F.lit(False))
    )
    ids = anchors.select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id"))
    order = ["anchor", F.desc("score"), F.desc("positive"), "vec_id", "row"]
    return (
        found.join(ids, F.col("anchor") == F.col("a_row"))
        .repartition("anchor").sortWithinPartitions(*order)
        .mapInPandas(
            _stream(negatives, low, high),
            "anchor_id long, positive_id long, rank int, negative_id long, "
            "positive_score long, negative_score long",
        )
    )


def _positives(rows: DataFrame, anchors: DataFrame, count: int, block_rows: int) -> DataFrame:
    """The ``count`` best rows of each anchor's label. Small labels share a block; a label
    that outgrows one is cut into several, which its anchors are copied to."""
    sizes = rows.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("n")).join(
        anchors.groupBy(F.col("label").alias("al")).agg(F.count("*").alias("a")),
        F.col("l") == F.col("al"),
    )
    bins = F.lit(max(1, -(-rows.count() // block_rows)))
    cut = cut_lineage(
        sizes.select(
            "l", F.pmod(F.xxhash64("l"), bins).cast("int").alias("bin"),
            F.ceil(F.col("n") / block_rows).cast("int").alias("row_cuts"),
            F.ceil(F.col("a") / block_rows).cast("int").alias("anchor_cuts"),
        )
    )
    of = lambda df: df.join(cut, F.col("label") == F.col("l"))
    here = of(rows).select(
        "bin", _dealt(rows, F.col("row_cuts"), "row").alias("part"),
        _copies(F.col("anchor_cuts")).alias("slab"), "row", "vec_id", "label", "vector",
    )
    asked = of(anchors).select(
        "bin", _dealt(anchors, F.col("anchor_cuts"), "anchor").alias("slab"),
        _copies(F.col("row_cuts")).alias("part"), "row", "label", "vector",
    ).toDF("a_bin", "a_slab", "a_part", "row", "label", "vector")
    found = asked.groupBy("a_bin", "a_part", "a_slab").cogroup(
        here.groupBy("bin", "part", "slab")
    ).applyInPandas(_best_positives(count), _PAIR)
    order = W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= count
    ).drop("place")


def _negatives(
    rows: DataFrame, anchors: DataFrame, best: DataFrame, count: int, low: int, high: int,
    block_rows: int,
) -> DataFrame:
    """Every block's best rows of other labels in the anchors' windows. Anchors without a
    positive ask for none."""
    opened = best.groupBy(F.col("anchor").alias("opened")).agg(
        F.collect_list("score").alias("positives")  # ``positives`` rows at most
    )
    asking = cut_lineage(anchors.join(opened, F.col("row") == F.col("opened")).drop("opened"))
    row_cuts = F.lit(max(1, -(-rows.count() // block_rows)))
    anchor_cuts = F.lit(max(1, -(-asking.count() // block_rows)))
    here = rows.select(
        _dealt(rows, row_cuts, "row").alias("part"), _copies(anchor_cuts).alias("slab"),
        "row", "vec_id", "label", "vector",
    )
    asked = asking.select(
        _copies(row_cuts).alias("a_part"), _dealt(asking, anchor_cuts, "anchor").alias("a_slab"),
        "row", "label", "vector", "positives",
    )
    return asked.groupBy("a_part", "a_slab").cogroup(here.groupBy("part", "slab")).applyInPandas(
        _best_negatives(count, low, high), _PAIR
    )
