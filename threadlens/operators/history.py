"""Earlier messages of the same customer, in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.operators.dedup import dedup
from threadlens.operators.sizing import (
    HOT_ROWS, MAX_HOT_KEYS, broadcast_bounded, measured_hot_keys,
)

MAX_PIECES = 4000
_LATE = 1 << 61  # rows without a readable time sort after all others


def _time_position(first: str, second: str) -> Column:
    """A number that grows with (first, second), null times last: used to cut only."""
    first_at = F.unix_micros(F.col(first).cast("timestamp"))
    second_at = F.unix_micros(F.col(second).cast("timestamp"))
    return F.coalesce(first_at, F.lit(_LATE) + second_at, F.lit(2 * _LATE - 1))


def _pieces(rows: DataFrame, key: str, position: str, hot: DataFrame) -> DataFrame:
    """Add ``piece``: 0 for ordinary keys, a running number of time slices for hot
    ones. Slices follow approximate quantiles; they only steer the work, the result
    does not depend on where the cuts fall."""
    # one parsed literal: building the list column by column would take seconds
    grid = F.expr("array(" + ",".join(f"{i / MAX_PIECES}D" for i in range(1, MAX_PIECES)) + ")")
    cuts = (
        rows.select(key, position)
        .join(hot, F.col(key) == F.col("hot_key"))
        .groupBy("hot_key", "salts")
        .agg(F.percentile_approx(position, grid, 10 * MAX_PIECES).alias("grid"))
        .select(
            "hot_key",
            # about one slice per salt: every (MAX_PIECES / salts)-th quantile
            F.expr(
                f"filter(grid, (x, i) -> (i + 1) % greatest(1, {MAX_PIECES} div salts) = 0)"
            ).alias("cuts"),
        )
    )
    cut_rows = rows.join(
        broadcast_bounded(cuts, MAX_HOT_KEYS), F.col(key) == F.col("hot_key"), "left"
    )
    piece = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(
        F.expr(f"size(filter(cuts, x -> x < {position}))")
    )
    return cut_rows.withColumn("piece", piece).drop("hot_key", "cuts")


_ORDER = ("customer_created_at", "brand_created_at", "brand_tweet_id")


def _with_halo(rows: DataFrame, key: str, hot: DataFrame, n: int) -> DataFrame:
    """Rows in time slices (``piece``), each slice of a hot key preceded by the ``n``
    rows before it, marked ``__halo``.

    The last n rows of every slice are numbered in time order per key (at most
    n x MAX_PIECES of them). The rows just before a slice are then the n numbered
    before that slice's own first one."""
    position = _time_position(*_ORDER[:2])
    rows = _pieces(rows.withColumn("__pos", position), key, "__pos", hot).drop("__pos")
    newest = W.partitionBy(key, "piece").orderBy(*[F.desc_nulls_first(c) for c in _ORDER])
    tails = (
        rows.join(hot, F.col(key) == F.col("hot_key"), "left_semi")
        .withColumn("__from_end", F.row_number().over(newest))
        .where(F.col("__from_end") <= n)
        .drop("__from_end")
    )
    in_time = W.partitionBy(key).orderBy("piece", *[F.asc_nulls_last(c) for c in _ORDER])
    numbered = tails.withColumn("__nr", F.row_number().over(in_time))
    starts = numbered.groupBy(F.col(key).alias("__k"), F.col("piece").alias("__to")).agg(
        F.min("__nr").alias("__start")
    )
    halo = (
        numbered.withColumn(
            "__next", F.explode(F.sequence(F.col("__nr") + 1, F.col("__nr") + n))
        )
        .join(starts, (F.col(key) == F.col("__k")) & (F.col("__next") == F.col("__start")))
        .select(
            *[c for c in rows.columns if c != "piece"],
            F.col("__to").alias("piece"), F.lit(True).alias("__halo"),
        )
    )
    return rows.withColumn("__halo", F.lit(False)).unionByName(halo)


def customer_history(
    pairs: DataFrame, n: int = 3, brand_label: str = "Brand", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per customer message: the previous ``n`` turns of the same customer, then the
    message. One row per customer message; the last reply's context wins.

    A customer with very many rows is cut into time slices that are handled by
    separate tasks; see ``_with_halo``."""
    key = "customer_author_id"
    rows = pairs.select(
        tx.norm_id("customer_tweet_id").alias("customer_tweet_id"),
        tx.norm_id("brand_tweet_id").alias("brand_tweet_id"),
        tx.text_or_empty(key).alias(key),
        tx.text_or_empty("customer_text").alias("customer_text"),
        tx.text_or_empty("brand_response").alias("brand_response"),
        "customer_created_at",
        "brand_created_at",
    ).where(F.col("customer_tweet_id").isNotNull())
    hot = measured_hot_keys(rows.select(key), key, hot_rows)
    if hot is None:
        within = [key]
    else:
        rows = _with_halo(rows, key, broadcast_bounded(hot, MAX_HOT_KEYS), n)
        within = [key, "piece"]
    here = W.partitionBy(*within).orderBy(*[F.asc_nulls_last(c) for c in _ORDER])
    turn = F.concat_ws(
        "\n",
        F.concat(F.lit("Customer: "), F.col("customer_text")),
        F.concat(F.lit(f"{brand_label}: "), F.col("brand_response")),
    )
    framed = rows.withColumn("__turn", turn)
    earlier = [F.lag("__turn", i).over(here) for i in range(n, 0, -1)]
    framed = framed.withColumn("__earlier", F.concat_ws("\n", *earlier))
    if hot is not None:
        framed = framed.where(~F.col("__halo"))
    context = F.when(F.col("__earlier") == "", F.col("customer_text")).otherwise(
        F.concat(F.col("__earlier"), F.lit("\nCustomer: "), F.col("customer_text"))
    )
    out = framed.select("customer_tweet_id", *_ORDER, context.alias("context_text"))
    return dedup(out, ["customer_tweet_id"], list(_ORDER), last=True).select(
        "customer_tweet_id", "context_text"
    )


def attach_context(split: DataFrame, context: DataFrame) -> DataFrame:
    """Add ``context_text`` by message id; without a match the message itself."""
    ctx = context.select(
        F.col("customer_tweet_id").alias("__id"), F.col("context_text").alias("__ctx")
    )
    return (
        split.withColumn("customer_tweet_id", tx.norm_id("customer_tweet_id"))
        .join(ctx, F.col("customer_tweet_id") == F.col("__id"), "left")
        .withColumn("context_text", F.coalesce("__ctx", "customer_text"))
        .drop("__id", "__ctx")
    )


def context_coverage(attached: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split and how many of them gained earlier turns."""
    return attached.groupBy(split_col).agg(
        F.count_if(F.col("context_text") != F.col("customer_text")).alias("with_context"),
        F.count("*").alias("total"),
    )
