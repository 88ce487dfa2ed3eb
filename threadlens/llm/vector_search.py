"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is clustered into centers of balanced size. Every vector is posted to
the list of its nearest center and also, near a border, to other lists whose centers are
almost as near. A search finds centers with a best-first walk over an in-memory graph
(each center is linked with its nearest ones and a few random ones) and reads the lists
whose center is at most ``ratio`` times as far as the nearest center. The ratio is
measured on the sample: it reaches the lists of ``coverage`` of the sample's own true
neighbours.

The largest inner product becomes the smallest distance through one more coordinate,
sqrt(M^2 - |x|^2) for a vector x and 0 for a query, with M the largest length.

Lists go to shards of about equal size. A list too long for one shard is spread over
several; a task searches one shard for one block of queries and returns the best ``k``
of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.vectors import cluster, sample, squared_distances, stacked, usable
from threadlens.session import cut_lineage, run_dir, scratch, store

TRAINING_ROWS, MAX_LISTS, LIST_ROWS = 20_000, 4_096, 200
LINKS, RANDOM_LINKS, WIDEN = 12, 4, 4
BORDER, COPIES = 1.05, 3  # a vector is posted to up to 3 lists within 5 % more distance
SHARD_ROWS, QUERY_ROWS = 8_192, 8_192
STEP = 512  # rows that walk the graph at a time
COVERAGE = 0.97


@dataclass
class Index:
    width: int
    longest: float
    centers: np.ndarray
    graph: np.ndarray
    ratio: float = 1.0
    beam: int = 64

    def lifted(self, vectors, queries: bool = False) -> np.ndarray:
        x = stacked(vectors, self.width)
        length = np.linalg.norm(x, axis=1)
        if queries:
            x = x * (self.longest / length)[:, None]
            return np.column_stack([x, np.zeros(len(x))])
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - length**2, 0))])

    def walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centers that a best-first walk finds for each row of ``x``, nearest
        first: (distances, centers). All rows walk at once."""
        k = len(self.centers)
        beam = min(beam, k)
        n, far = len(x), np.inf
        seen = np.zeros((n, k), bool)
        start = np.linspace(0, k - 1, min(8, k)).astype(int)
        ids = np.full((n, beam + len(start)), -1)
        dist = np.full(ids.shape, far)
        ids[:, : len(start)] = start
        dist[:, : len(start)] = np.sqrt(squared_distances(x, self.centers[start]))
        seen[:, start] = True
        done = np.zeros(ids.shape, bool)
        ids, dist, done = _best(ids, dist, done, beam)
        own = np.arange(n)[:, None]
        while True:
            open_dist = np.where(done | ~np.isfinite(dist), far, dist)
            width = min(WIDEN, beam)
            pick = np.argpartition(open_dist, width - 1, axis=1)[:, :width]
            going = np.isfinite(open_dist[own, pick])
            if not going.any():
                return dist, ids
            done[own, pick] |= going
            around = np.where(going[:, :, None], self.graph[ids[own, pick]], -1).reshape(n, -1)
            around = np.sort(around, axis=1)
            fresh = around >= 0
            fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
            fresh &= ~seen[own, around]
            r, c = np.nonzero(fresh)
            new = around[r, c]
            seen[r, new] = True
            d = np.full(around.shape, far)
            d[r, c] = np.sqrt(np.maximum(((x[r] - self.centers[new]) ** 2).sum(1), 0))
            ids, dist, done = _best(
                np.concatenate([ids, around], 1), np.concatenate([dist, d], 1),
                np.concatenate([done, np.zeros(around.shape, bool)], 1), beam,
            )


def _best(ids, dist, done, beam: int):
    order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
    own = np.arange(len(ids))[:, None]
    return ids[own, order], dist[own, order], done[own, order]


def build_index(
    rows: np.ndarray, longest: float, total: int, k: int = 20, coverage: float = COVERAGE,
    lists: int | None = None,
) -> Index:
    """From a bounded sample of vectors; ``total`` is the number of vectors to index."""
    lists = lists or int(min(MAX_LISTS, max(1, round(total / LIST_ROWS))))
    index = Index(rows.shape[1], longest, np.zeros((1, 1)), np.zeros((1, 1), int))
    lifted = index.lifted(rows)
    index.centers = cluster(lifted, lists, balanced=True)
    index.graph = _graph(index.centers)
    _measure_ratio(index, rows, lifted, k, coverage)
    return index


def _graph(centers: np.ndarray) -> np.ndarray:
    """Each center's nearest centers, some random ones, and the next one in order, which
    keeps the graph in one piece."""
    n = len(centers)
    if n == 1:
        return np.zeros((1, 1), int)
    near = np.argsort(squared_distances(centers, centers), axis=1, kind="stable")
    near = near[:, 1 : 1 + LINKS]
    other = np.random.default_rng(11).integers(0, n, (n, RANDOM_LINKS))
    return np.concatenate([near, other, ((np.arange(n) + 1) % n)[:, None]], axis=1)


def _measure_ratio(index: Index, rows: np.ndarray, lifted: np.ndarray, k: int, coverage: float):
    """How much farther than the nearest center the lists of true neighbours are."""
    some = np.linspace(0, len(rows) - 1, min(400, len(rows))).astype(int)
    product = rows[some] @ rows.T
    product[np.arange(len(some)), some] = -np.inf
    k = min(k, len(rows) - 1)
    if k < 1:
        return
    best = np.argpartition(-product, k - 1, axis=1)[:, :k]
    d = np.sqrt(squared_distances(index.lifted(rows[some], queries=True), index.centers))
    near = best.reshape(-1)
    parts = [_posted(index, lifted[near[i : i + STEP]]) for i in range(0, len(near), STEP)]
    posted, where = (np.concatenate(x) for x in zip(*parts))
    reach = np.where(posted, np.take_along_axis(np.repeat(d, k, axis=0), where, 1), np.inf).min(1)
    ratio = reach / np.repeat(np.maximum(d.min(1), 1e-12), k)
    index.ratio = float(np.quantile(ratio, coverage)) + 1e-9
    within = (d <= index.ratio * d.min(1)[:, None]).sum(1)
    index.beam = int(min(len(index.centers), max(64, 1.25 * within.max())))


def _posted(index: Index, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether, list) of up to ``COPIES`` lists per vector; the first always holds it."""
    dist, ids = index.walk(lifted, 16)
    dist, ids = dist[:, :COPIES], ids[:, :COPIES]
    posted = dist <= BORDER * dist[:, :1]
    posted[:, 0] = True
    return posted, np.maximum(ids, 0)


def _post(index: Index):
    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), STEP):
                part = batch.iloc[at : at + STEP]
                posted, where = _posted(index, index.lifted(part["vec"].to_list()))
                r, c = np.nonzero(posted)
                yield part.iloc[r].assign(list=where[r, c])

    return post


def _probe(index: Index, everywhere: bool):
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), STEP):
                part = batch.iloc[at : at + STEP]
                if everywhere:
                    lists = [np.arange(len(index.centers))] * len(part)
                else:
                    x = index.lifted(part["vec"].to_list(), queries=True)
                    dist, ids = index.walk(x, index.beam)
                    near = dist <= index.ratio * dist[:, :1]
                    near[:, 0] = True
                    lists = [i[m] for i, m in zip(ids, near)]
                yield part.assign(lists=lists)

    return probe


def _search(width: int, k: int):
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy(bool)
        q, s = frame[asks], frame[~asks]
        found: list[tuple] = []
        if len(q) and len(s):
            x = stacked(s["vec"].to_list(), width)
            ids, held = s["id"].to_numpy(np.int64), s["list"].to_numpy(np.int64)
            names, of = np.unique(ids, return_inverse=True)
            for at in range(0, len(q), 128):
                part = q.iloc[at : at + 128]
                y = stacked(part["vec"].to_list(), width)
                near = y @ x.T
                for i, (own, lists) in enumerate(zip(part["id"], part["lists"])):
                    use = np.flatnonzero(np.isin(held, lists) & (ids != own))
                    if len(use) == 0:
                        continue
                    # An id may be there any number of times; its best row counts.
                    best = np.full(len(names), -np.inf)
                    np.maximum.at(best, of[use], near[i, use])
                    last = len(names) - k
                    if last > 0:  # ties with the last stay for the exact order
                        floor = np.partition(best, last)[last]
                        if np.isfinite(floor):
                            floor -= 1e-9 * (1 + abs(floor))
                        use = use[near[i, use] >= floor]
                    found += _ranked(own, y[i], ids[use], x[use], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )

    return search


def _ranked(own: int, query: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple]:
    """The best ``k``; products are summed in order, so equal vectors score alike."""
    score = np.zeros(len(ids))
    for d in range(x.shape[1]):
        score += query[d] * x[:, d]
    order = np.lexsort((ids, -score))
    out, seen = [], set()
    for i in order:
        if ids[i] not in seen:
            out.append((own, ids[i], score[i]))
            seen.add(ids[i])
        if len(out) == k:
            break
    return out


def search_vectors(
    vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id",
    vec: str = "embedding", training_rows: int = TRAINING_ROWS, coverage: float = COVERAGE,
    lists: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors with the largest inner product
    that the index finds for each query, ties to the smaller id; the query's own id never.

    ``queries`` has the columns of ``vectors``. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows without an id, take no part on either side.
    Rows that repeat an id are one candidate (its best row) and one query per row merged
    into one list. A shorter vector counts as filled with zeros. A query for which the
    lists give fewer than ``k`` candidates, though there are more, is searched in all
    lists, which is exact. Ids must be integers."""
    spark = vectors.sparkSession
    # Floats stay floats where they are stored and shuffled; they are computed with as doubles.
    floats = all(_floats(df, vec) for df in (vectors, queries))
    kind = "array<float>" if floats else "array<double>"
    stored, asked = (
        cut_lineage(
            df.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast(kind).alias("vec"))
            .where(F.col("id").isNotNull() & usable("vec"))
        )
        for df in (vectors, queries)
    )
    whole = F.col("vec").cast("array<double>")
    square = F.aggregate(whole, F.lit(0e0), lambda a, x: a + x * x)
    total, longest, width = stored.agg(F.count("*"), F.max(square), F.max(F.size("vec"))).first()
    width = max(width or 0, asked.agg(F.max(F.size("vec"))).first()[0] or 0)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total or asked.isEmpty():
        return empty
    chosen = sample(stored, "id", training_rows, total).orderBy("id", "vec").select("vec").collect()
    if not chosen:
        chosen = stored.orderBy("id", "vec").select("vec").take(1)
    rows = stacked([r["vec"] for r in chosen], width)
    index = build_index(rows, float(np.sqrt(longest)) * (1 + 1e-12), total, k, coverage, lists)
    posted = cut_lineage(
        stored.mapInPandas(_post(index), f"id long, vec {kind}, list int")
    )
    found = _found(posted, asked, index, k, everywhere=False)
    enough = F.lit(min(k, total - 1))
    short = asked.join(
        found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough),
        F.col("id") == F.col("query_id"), "left_anti",
    )
    short = cut_lineage(short)
    if not short.isEmpty():
        again = _found(posted, short, index, k, everywhere=True)
        ids = short.select(F.col("id").alias("short")).distinct()
        rest = found.join(ids, F.col("query_id") == F.col("short"), "left_anti")
        found = rest.unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def _floats(df: DataFrame, vec: str) -> bool:
    kind = df.schema[vec].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)


def _shards(posted: DataFrame, lists: int) -> tuple[list[int], list[int]]:
    """For each list its first shard and how many it is spread over. There are at most
    ``MAX_LISTS`` lists, so their sizes fit the driver."""
    size = np.zeros(lists, np.int64)
    for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect():
        size[r["list"]] = r["n"]
    first, spread, shard, used = [0] * lists, [1] * lists, 0, 0
    for i in np.argsort(-size, kind="stable"):
        parts = max(1, -(-int(size[i]) // SHARD_ROWS))
        if used and used + size[i] > SHARD_ROWS:
            shard, used = shard + 1, 0
        first[i], spread[i] = shard, parts
        if parts > 1:
            shard, used = shard + parts, 0
        else:
            used += int(size[i])
    return first, spread


def _found(posted: DataFrame, asked: DataFrame, index: Index, k: int, everywhere: bool):
    """The best ``k`` that the lists give for each query, stored. A block of queries is
    searched at a time: the vectors it asks for are shuffled and dropped again, so that
    disk does not grow with the number of blocks."""
    spark = posted.sparkSession
    first, spread = _shards(posted, len(index.centers))
    begin = F.array(*map(F.lit, first))
    width = F.array(*map(F.lit, spread))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    probes = asked.mapInPandas(
        _probe(index, everywhere), f"id long, vec {asked.schema['vec'].dataType.simpleString()}, lists array<int>"
    )
    shards = F.array_distinct(
        F.flatten(
            F.transform(
                "lists",
                lambda i: F.sequence(F.get(begin, i), F.get(begin, i) + F.get(width, i) - 1),
            )
        )
    )
    shard = F.get(begin, F.col("list")) + F.pmod(F.xxhash64("id"), F.get(width, F.col("list")))
    in_shard = lambda i: F.col("shard").between(
        F.get(begin, i), F.get(begin, i) + F.get(width, i) - 1
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    path = run_dir(spark, "table")
    with scratch(spark):
        probes = cut_lineage(probes)
        for b in range(blocks):
            # To a shard goes what it holds of a query's lists, not all of them.
            asking = probes.where(block == b).select(
                "id", "vec", "lists", F.explode(shards).alias("shard")
            ).select(
                "id", "vec", F.lit(-1).alias("list"), F.filter("lists", in_shard).alias("lists"),
                F.lit(True).alias("asks"), "shard",
            )
            # Of the shards those that the block asks for.
            wanted = asking.select(F.col("shard").alias("wanted")).distinct()
            held = (
                posted.withColumn("shard", shard.cast("int"))
                .join(wanted, F.col("shard") == F.col("wanted"))
                .select(
                    "id", "vec", "list", F.array().cast("array<int>").alias("lists"),
                    F.lit(False).alias("asks"), "shard",
                )
            )
            best = (
                held.unionByName(asking).groupBy("shard")
                .applyInPandas(_search(index.width, k), "query_id long, vec_id long, score double")
                .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            )
            ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            store(ranked, path, "append")
    return spark.read.schema(ranked.schema).parquet(path)
