"""Best-fit packing of token sequences in bulk-synchronous rounds.

Each round sorts the documents still to place and the gaps of the open sequences by
size, largest first, over range partitions. In that order a document's best fit is the
last gap before it that no earlier document has taken: documents and gaps match like
brackets. Every partition matches its own rows; what is left over (documents without a
gap, then gaps without a document) is matched across partitions by nesting depth, which
follows from the partitions' left-over counts. A gap goes to the document ranked next to
it, the others wait. Then the gaps shrink and the next round begins.

A gap that surely holds several of the remaining documents is offered in as many equal
slots. New sequences are opened only for documents that no gap can hold any more, as
many as their tokens need at least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.common import packed_row, unpacked
from threadlens.llm.encoding import encoded_segments, fold, load_tokenizer, word_cut
from threadlens.session import cut_lineage

CAPACITY = 2048


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load_tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            encoded = encoded_segments(tokenizer, batch["text"], word_cut, fold, name=path)
            rows = []
            for doc_id, parts in zip(batch["doc_id"], encoded):
                data = b"".join(parts) + end
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    some = data[at : at + 4 * capacity]
                    row = (doc_id, i, at // 4, len(some) // 4, zlib.crc32(some))
                    rows.append((*row, np.frombuffer(some, "<i4")) if with_ids else row)
                if len(rows) >= 10_000:
                    yield _frame(rows, names)
                    rows = []
            yield _frame(rows, names)

    return cut


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.assign(doc_id=pd.array(frame["doc_id"], dtype="Int64"))


def token_pieces(
    docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id",
    capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's token ids and
    ``end_id``, cut into pieces of ``capacity`` ids; only the last may be shorter.

    ``path`` names a vocabulary for the ``tokenizers`` library that drops white space and
    never merges across it, readable on every executor. A null or empty text is the end
    id alone. Ids must be integers; they may be null or repeat."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    return rows.mapInPandas(
        _pieces(path, capacity, end_id, with_ids), schema + ", ids array<int>" * with_ids
    )


def _match_local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Match a range partition's sorted rows like brackets: gaps open, items close.
    Gives matched pairs, and what is left with its place among the left-overs."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    is_item = rows["item"].notna().to_numpy()
    walk = np.cumsum(np.where(is_item, -1, 1))
    depth = np.where(is_item, walk + 1, walk)
    order = np.argsort(depth, kind="stable")
    level, kind = depth[order], is_item[order]
    pair = np.flatnonzero((level[:-1] == level[1:]) & ~kind[:-1] & kind[1:])
    gap, item = order[pair], order[pair + 1]
    for name in ("item", "len"):
        values = rows[name].to_numpy(copy=True)
        values[gap] = values[item]
        rows[name] = values
    rows["place"] = np.nan
    left = np.ones(len(rows), bool)
    left[gap] = left[item] = False
    for kind in (True, False):
        some = np.flatnonzero(left & (is_item == kind))
        rows.loc[some, "place"] = np.arange(len(some))
    keep = np.ones(len(rows), bool)
    keep[item] = False
    rows = rows[keep].assign(part=TaskContext.get().partitionId())
    rows = rows.drop(columns="size").astype(
        {c: "Int64" for c in ("bin", "slot", "gap", "item", "len", "place")}
    )
    yield rows[["part", "bin", "slot", "gap", "item", "len", "place"]]


SWEPT = "part int, bin long, slot long, gap long, item long, len long, place long"


def _sweep(items: DataFrame, slots: DataFrame) -> DataFrame:
    """One round: (bin, slot, gap, item, len); matched rows have bin and item."""
    none = F.lit(None).cast("long")
    rows = slots.select("size", "bin", "slot", "gap", none.alias("item"), none.alias("len"))
    rows = rows.unionByName(
        items.select(
            F.col("len").alias("size"), none.alias("bin"), none.alias("slot"),
            none.alias("gap"), "item", "len",
        )
    )
    order = [F.col("size").desc(), F.col("item").asc_nulls_first(), F.col("bin"), F.col("slot")]
    swept = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInPandas(_match_local, SWEPT)
    )
    left = swept.where("place IS NOT NULL")
    # One row per range partition: documents left over, then gaps left over.
    counts = left.groupBy("part").agg(F.count("item").alias("a"), F.count("bin").alias("b"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    start = counts.select(
        F.col("part").alias("p"), "a",
        F.coalesce(F.sum(F.col("b") - F.col("a")).over(earlier), F.lit(0)).alias("start"),
    )
    depth = F.when(F.col("item").isNotNull(), F.col("start") - F.col("place")).otherwise(
        F.col("start") - F.col("a") + F.col("place") + 1
    )
    # Each partition has at most one document and one gap of a depth.
    level = W.partitionBy("depth").orderBy("part", F.col("item").isNull())
    after, before = F.lead("item").over(level), F.lag("bin").over(level)
    crossed = (
        left.join(start, F.col("part") == F.col("p")).withColumn("depth", depth)
        .withColumn("next", after).withColumn("next_len", F.lead("len").over(level))
        .withColumn("taken", F.col("item").isNotNull() & before.isNotNull())
        .where(~F.col("taken"))
        .select(
            "bin", "slot", "gap", F.coalesce("item", F.when(F.col("bin").isNotNull(), F.col("next"))).alias("item"),
            F.coalesce("len", F.when(F.col("bin").isNotNull(), F.col("next_len"))).alias("len"),
        )
    )
    matched = swept.where("place IS NULL").select("bin", "slot", "gap", "item", "len")
    return cut_lineage(matched.unionByName(crossed))


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, bin, offset) for (item, len): unique long items of 1 to ``capacity`` tokens
    put into bins without holes, offsets gapless from 0, in nearly as few bins as possible.

    Equal lengths are ordered by item, so the result depends on the input alone."""
    spark = items.sparkSession
    left = cut_lineage(items.select("item", F.col("len").cast("long").alias("len")))
    bins = spark.createDataFrame([], "bin long, gap long")
    opened, placed = 0, []
    while True:
        # Sizes lie between 1 and the capacity, so this is a small table.
        sizes = left.groupBy("len").agg(F.count("*").alias("n")).collect()
        if not sizes:
            break
        count = {r["len"]: r["n"] for r in sizes}
        least, most = min(count), max(count)
        bins = bins.where(F.col("gap") >= least)
        widest = bins.agg(F.max("gap")).first()[0] or 0
        homeless = {s: n for s, n in count.items() if s > widest}
        new = max(
            -(-sum(s * n for s, n in homeless.items()) // capacity),
            sum(n for s, n in homeless.items() if 2 * s > capacity),
        )
        fresh = spark.range(opened, opened + new).select(
            F.col("id").alias("bin"), F.lit(capacity).cast("long").alias("gap")
        )
        opened += new
        slots = F.greatest(F.lit(1), F.floor(F.col("gap") / most)).cast("long")
        offered = (
            bins.unionByName(fresh).withColumn("slots", slots)
            .withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("slots"))))
            .withColumn("size", F.floor(F.col("gap") / F.col("slots")))
        )
        swept = _sweep(left, offered)
        filled = swept.where("bin IS NOT NULL AND item IS NOT NULL")
        inside = W.partitionBy("bin").orderBy("slot")  # at most ``capacity`` rows
        earlier = inside.rowsBetween(W.unboundedPreceding, -1)
        offset = capacity - F.col("gap") + F.coalesce(F.sum("len").over(earlier), F.lit(0))
        placed.append(filled.select("item", "bin", offset.cast("long").alias("offset")))
        bins = swept.where("bin IS NOT NULL").groupBy("bin").agg(
            (F.max("gap") - F.coalesce(F.sum("len"), F.lit(0))).alias("gap")
        )
        bins = cut_lineage(bins)
        left = swept.where("bin IS NULL").select("item", "len")
    out = spark.createDataFrame([], "item long, bin long, offset long")
    for part in placed:
        out = out.unionByName(part)
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) with ``sequence_id`` and
    ``offset``. A piece of full length is a sequence of its own; the others are packed by
    ``best_fit``. Columns of these names are replaced; no rows give no rows."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    stored = cut_lineage(
        pieces.select(packed_row(names), "length", F.monotonically_increasing_id().alias("number"))
    )
    part = stored.where(F.col("length") < capacity)
    items = part.select(F.col("number").alias("item"), F.col("length").alias("len"))
    packed = best_fit(items, capacity)
    whole = stored.where(F.col("length") >= capacity).select(
        "row", (-1 - F.col("number")).alias("bin"), F.lit(0).cast("long").alias("offset")
    )
    placed = part.join(packed, F.col("number") == F.col("item")).select("row", "bin", "offset")
    return whole.unionByName(placed).select(
        *unpacked(names), F.col("bin").alias("sequence_id"), "offset"
    )
