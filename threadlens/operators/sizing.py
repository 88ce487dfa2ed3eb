"""Choices that depend on data size: broadcasting and hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 250_000
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000


def broadcast_bounded(df: DataFrame, bound: int | None) -> DataFrame:
    """Broadcast a side whose row count is known never to exceed ``bound``.

    ``bound`` comes from the operator (a label list, a top-k, a capped
    vocabulary), not from the data. Without one the join is left to adaptive
    execution, which broadcasts only what it has measured to be small."""
    return F.broadcast(df) if bound is not None and bound <= BROADCAST_ROWS else df


def never_null(key: Column | str, row_id: Column | str) -> Column:
    """A left-join key that sends rows without a key to different partitions.

    Null keys hash alike, so a left join would gather every unkeyed row (say all
    thread openers) in one task. They get a private value that matches nothing."""
    key = F.col(key) if isinstance(key, str) else key
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.coalesce(key.cast("string"), F.concat(F.lit("\x00"), row_id.cast("string")))


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(hot_key, salts) for keys that own too many rows.

    A key is hot above ``hot_rows`` rows and above a 1/MAX_HOT_KEYS share of all
    rows, so there are never more than MAX_HOT_KEYS of them, whatever the size of
    the data: the result is safe to broadcast. Counted with partial aggregation."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    share = counts.agg(F.sum("n") / MAX_HOT_KEYS).scalar()
    limit = F.greatest(F.lit(float(hot_rows)), share)
    return counts.where(F.col("n") > limit).select(
        F.col(key).alias("hot_key"), F.ceil(F.col("n") / limit).cast("int").alias("salts")
    )


def measured_hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Count the keys now; None when no key is hot, which keeps the usual plan plain.
    At most MAX_HOT_KEYS rows come back to the driver."""
    hot = hot_keys(df, key, hot_rows)
    rows = hot.collect()
    return df.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def salted_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    row_id: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join where a key may own a large share of ``left``.

    ``right`` holds few rows per key. Rows of a hot key are spread over
    ``salts`` sub-keys and only the matching rows of ``right`` are repeated that
    often; every other key joins as usual. Same rows as the plain join, which is
    what runs when no key is hot."""
    if how == "inner":
        left = left.where(F.col(left_key).isNotNull())
        lkey = F.col(left_key)
    else:
        lkey = never_null(left_key, F.concat_ws("\x00", *row_id))
    lhs = left.withColumn("__key", lkey)
    rkey = F.col(right_key) if how == "inner" else F.col(right_key).cast("string")
    on = F.col("__key") == rkey
    hot = measured_hot_keys(left.select(left_key), left_key, hot_rows)
    if hot is None:
        return lhs.join(right, on, how).drop("__key")
    hot = broadcast_bounded(hot, MAX_HOT_KEYS)
    salts = F.coalesce("salts", F.lit(1))
    lhs = (
        lhs.join(hot, F.col(left_key) == F.col("hot_key"), "left")
        .withColumn("__salt", F.pmod(F.xxhash64(*row_id), salts).cast("int"))
        .drop("hot_key", "salts")
    )
    rhs = (
        right.join(hot, F.col(right_key) == F.col("hot_key"), "left")
        .withColumn("__rsalt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("hot_key", "salts")
    )
    same_salt = F.col("__salt") == F.col("__rsalt")
    return lhs.join(rhs, on & same_salt, how).drop("__key", "__salt", "__rsalt")
