"""Near-duplicate vectors by product quantisation, without losing a link.

Unit vectors of cosine c or more lie within r = sqrt(2 - 2c) of each other. Vectors are
dealt to inverted lists by their nearest coarse center and stored there with subspace
codes of their residual and the length ``err`` of what the codes leave out. Each vector
asks every list that can hold a neighbour: its distance from the plane between its own
center and the list's must not exceed r, as any neighbour lies beyond that plane. In a
list, table look-ups give the distance ``d`` to each coded vector; d - err <= r must hold
for a neighbour (triangle inequality). What remains is ranked by the exact cosine.

Equal vectors of a label are one class with a count. Long lists and their questions are
cut into blocks, and a task compares one block with another: it returns link counts and
one root per vector, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.graph import components
from threadlens.llm.vectors import cluster, sample, squared_distances, stacked, usable
from threadlens.session import cut_lineage

TRAINING_ROWS, MAX_LISTS, SUBSPACES, CODEWORDS = 20_000, 1_024, 8, 64
BLOCK = 1_024
PIECE = "cls long, rep long, links long, root long"
_SLACK = 1e-6  # for rounding: only makes candidates of more pairs
_SLICE = 1 << 20  # numbers of one side that are multiplied at a time


@dataclass
class Codebook:
    """Coarse centers and, per subspace, the codewords of residuals."""

    width: int
    centers: np.ndarray
    cuts: list[np.ndarray]
    words: list[np.ndarray]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.zeros((len(residual), len(self.cuts)), np.uint8)
        lost = np.zeros(len(residual))
        for m, (cut, words) in enumerate(zip(self.cuts, self.words)):
            d = squared_distances(residual[:, cut], words)
            codes[:, m] = d.argmin(1)
            lost += ((residual[:, cut] - words[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(lost)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric: exact residuals of questions against coded residuals."""
        total = np.zeros((len(residual), len(codes)))
        for m, (cut, words) in enumerate(zip(self.cuts, self.words)):
            total += squared_distances(residual[:, cut], words)[:, codes[:, m]]
        return np.sqrt(total)


def fit_codebook(vectors: np.ndarray, total: int, lists: int | None = None) -> Codebook:
    """From a bounded sample; ``total`` is the number of vectors to index. The number of
    lists grows with its square root."""
    width = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    lists = lists or int(min(MAX_LISTS, max(1, np.sqrt(total) / 4)))
    centers = cluster(unit, lists)
    residual = unit - centers[squared_distances(unit, centers).argmin(1)]
    cuts = [c for c in np.array_split(np.arange(width), min(SUBSPACES, width)) if len(c)]
    return Codebook(width, centers, cuts, [cluster(residual[:, c], CODEWORDS) for c in cuts])


def _deal(book: Codebook, radius: float):
    """A stored row in the nearest list, and a question for each list to ask."""
    gaps = np.sqrt(squared_distances(book.centers, book.centers))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                x = stacked(part["vec"].to_list(), book.width)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                d = squared_distances(x, book.centers)
                own = d.argmin(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d - d[np.arange(len(x)), own][:, None]) / (2 * gaps[own])
                ask = plane <= radius + _SLACK
                ask[np.arange(len(x)), own] = True
                rows, lists = np.nonzero(ask)
                yield part.assign(list=own, asks=False)
                yield part.iloc[rows].assign(list=lists, asks=True)

    return deal


def exact_cosines(a, b, na, nb, i, j) -> np.ndarray:
    """Cosines of the rows ``i`` of ``a`` with the rows ``j`` of ``b``, pair by pair."""
    return np.einsum("ij,ij->i", a[i], b[j]) / (na[i] * nb[j])


def _compare(book: Codebook, cosine: float, radius: float):
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy(bool)
        q, s = frame[asks], frame[~asks]
        if q.empty or s.empty:
            return pd.DataFrame(columns=["cls", "rep", "links", "root"]).astype("int64")
        a, b = (stacked(f["vec"].to_list(), book.width) for f in (q, s))
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        center = book.centers[int(frame["list"].iat[0])]
        codes, err = book.encode(b / nb[:, None] - center)
        near = book.distances(a / na[:, None] - center, codes) - err <= radius + _SLACK
        ids_q, ids_s = q["rep"].to_numpy(), s["rep"].to_numpy()
        others = q["cls"].to_numpy()[:, None] != s["cls"].to_numpy()[None, :]
        linked = np.zeros(near.shape, dtype=bool)
        rows, cols = np.nonzero(near & others)
        for at in range(0, len(rows), step := max(1, _SLICE // book.width)):
            i, j = rows[at : at + step], cols[at : at + step]
            linked[i, j] = exact_cosines(a, b, na, nb, i, j) >= cosine
        links = linked @ s["n"].to_numpy(np.int64)
        root_q, root_s = ids_q.copy(), ids_s.copy()
        rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        some, most = linked[np.ix_(rows, cols)], np.iinfo(np.int64).max
        while len(rows):  # smallest id around, until nothing changes
            rq = np.minimum(root_q[rows], np.where(some, root_s[cols], most).min(1))
            rs = np.minimum(root_s[cols], np.where(some, rq[:, None], most).min(0))
            if (rq == root_q[rows]).all() and (rs == root_s[cols]).all():
                break
            root_q[rows], root_s[cols] = rq, rs
        out = pd.DataFrame(
            {
                "cls": np.concatenate([q["cls"], s["cls"]]),
                "rep": np.concatenate([ids_q, ids_s]),
                "links": np.concatenate([links, np.zeros(len(s), np.int64)]),
                "root": np.concatenate([root_q, root_s]),
            }
        )
        return out[(out["links"] > 0) | (out["rep"] != out["root"])]

    return compare


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label",
    cosine: float = 0.98, training_rows: int = TRAINING_ROWS, block: int = BLOCK,
    lists: int | None = None,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of equal label are linked at a cosine of ``cosine`` or more, in doubles.
    ``n_links`` counts the other rows a row is linked with, ``component_id`` is the
    smallest id that links reach. Vectors that are null, empty, zero or hold null or
    non-finite components, rows without a label and rows without an id link with nothing.
    Rows that repeat an id are separate vectors that share a component. A shorter vector
    counts as filled with zeros. Ids must be integers."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    double = F.col(vec).cast("array<double>")
    code = [F.xxhash64(F.lit(s), F.col("label").cast("string"), "vec") for s in (1, 2)]
    rows = cut_lineage(
        vectors.select(
            F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
            double.alias("vec"),
        )
        .withColumn(
            "takes_part",
            usable("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull(),
        )
        .withColumns({"c1": code[0], "c2": code[1]})
    )
    real = rows.where("takes_part")
    counted = cut_lineage(
        real.groupBy("c1", "c2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    )
    first = counted.select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), "rep", "n")
    same = (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2"))
    classes = cut_lineage(
        real.join(first, same & (F.col("vec_id") == F.col("rep")))
        .select("d1", "d2", "rep", "n", "label", "vec").dropDuplicates(["d1", "d2"])
        .withColumn("cls", F.monotonically_increasing_id())
    )
    one = classes.select("d1", "d2", "cls", "rep", "n")
    total, width = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not total:
        found = rows.sparkSession.createDataFrame([], PIECE)
    else:
        chosen = sample(classes, "rep", training_rows, total).orderBy("rep").select("vec").collect()
        if not chosen:  # a few rows may all miss a thin sample
            chosen = classes.orderBy("rep").select("vec").take(1)
        book = fit_codebook(stacked([r["vec"] for r in chosen], width), total, lists)
        found = _linked(classes, book, cosine, radius, block)
    found = cut_lineage(found)
    sums = found.groupBy(F.col("cls").alias("c")).agg(F.sum("links").alias("links"))
    # Rows of one id with different vectors share a component.
    several = real.groupBy("vec_id").agg(F.min("c1").alias("low"), F.max("c1").alias("high"))
    several = several.where("low <> high").select(F.col("vec_id").alias("again"))
    repeated = real.join(several, F.col("vec_id") == F.col("again"), "left_semi").join(one, same)
    links = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(
        repeated.select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    )
    group = components(links)
    group = group.withColumnRenamed("node", "g")
    known = cut_lineage(
        one.join(sums, F.col("cls") == F.col("c"), "left")
        .join(group, F.col("rep") == F.col("g"), "left")
        .select(
            "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    out = rows.join(known, same & F.col("takes_part"), "left")
    out = out.withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _linked(classes: DataFrame, book: Codebook, cosine: float, radius: float, block: int):
    """(cls, rep, links, root) pieces from the comparisons of blocks."""
    label = classes.schema["label"].dataType.simpleString()
    dealt = cut_lineage(
        classes.select("cls", "rep", "n", "label", "vec").mapInPandas(
            _deal(book, radius),
            f"cls long, rep long, n long, label {label}, vec array<double>, list int, asks boolean",
        )
    )
    sizes = cut_lineage(
        dealt.groupBy("label", "list")
        .agg(
            F.ceil(F.count_if("asks") / block).cast("int").alias("qb"),
            F.ceil(F.count_if(~F.col("asks")) / block).cast("int").alias("sb"),
        )
        .where("qb > 0 AND sb > 0")
        .select(F.col("label").alias("l"), F.col("list").alias("i"), "qb", "sb")
    )
    both = (F.col("label") == F.col("l")) & (F.col("list") == F.col("i"))
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("asks"), F.col("qb")).otherwise(F.col("sb")))
    others = F.when(F.col("asks"), F.col("sb")).otherwise(F.col("qb"))
    cells = (
        dealt.join(sizes, both)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        .withColumn("q", F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")))
        .withColumn("s", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")))
        .select("cls", "rep", "n", "label", "vec", "list", "asks", "q", "s")
    )
    return cells.groupBy("label", "list", "q", "s").applyInPandas(
        _compare(book, cosine, radius), PIECE
    )
