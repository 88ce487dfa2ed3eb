"""Reply threads by bounded pointer walks.

The depth is a small constant, so a walk is that many left equi-joins on the
message id. Rows whose walk has ended carry a private key (``never_null``), so
they spread evenly instead of meeting in the null partition; a parent with very
many replies is split by adaptive skew-join handling.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.operators.dedup import dedup
from threadlens.operators.pairing import matched_replies
from threadlens.operators.sizing import HOT_ROWS, never_null

CONTEXT_COLUMNS = [
    "customer_tweet_id", "brand_tweet_id", "customer_author_id",
    "current_customer_message", "historical_brand_response", "conversation_context",
    "context_turn_count", "customer_created_at", "brand_created_at",
]


def _seen(pointer: Column, visited: list[Column]) -> Column:
    """``visited`` entries may be null past the end of a walk; those never match."""
    return reduce(or_, [v.eqNullSafe(pointer) for v in visited])


def chain_turns(
    tweets: DataFrame, brand: str, n: int = 3, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Walk up from the answered message, at most ``n`` messages including it.

    Adds ``turns``: ARRAY<STRUCT<hop, is_brand, text>> with hop 0 the answered
    message. A blank message uses up a hop but gives no turn; a repeated or
    unknown id ends the walk."""
    nodes = tweets.select("tweet_id", "author_id", "text", "in_response_to_tweet_id")
    walk = matched_replies(tweets, brand, hot_rows).select(
        "customer_tweet_id", "brand_tweet_id", "customer_author_id",
        tx.squash_ws("customer_text").alias("current_customer_message"),
        tx.squash_ws("brand_response").alias("historical_brand_response"),
        "customer_created_at", "brand_created_at",
        F.col("customer_in_response_to").alias("ptr_1"),
    )
    visited = [F.col("customer_tweet_id")]
    for h in range(1, n):
        live = F.when(~_seen(F.col(f"ptr_{h}"), visited), F.col(f"ptr_{h}"))
        step = nodes.select(
            F.col("tweet_id").alias(f"id_{h}"),
            F.col("author_id").eqNullSafe(F.lit(brand)).alias(f"brand_{h}"),
            tx.squash_ws("text").alias(f"text_{h}"),
            F.col("in_response_to_tweet_id").alias(f"ptr_{h + 1}"),
        )
        walk = (
            walk.withColumn("__key", never_null(live, "brand_tweet_id"))
            .join(step, F.col("__key") == F.col(f"id_{h}").cast("string"), "left")
            .drop("__key")
        )
        visited.append(F.col(f"id_{h}"))

    def turn(hop: int, is_brand: Column, text: Column) -> Column:
        return F.when(
            text != "",
            F.struct(F.lit(hop).alias("hop"), is_brand.alias("is_brand"), text.alias("text")),
        )

    turns = [turn(0, F.lit(False), F.col("current_customer_message"))]
    turns += [turn(h, F.col(f"brand_{h}"), F.col(f"text_{h}")) for h in range(1, n)]
    return walk.select(
        "customer_tweet_id", "brand_tweet_id", "customer_author_id",
        "current_customer_message", "historical_brand_response",
        "customer_created_at", "brand_created_at",
        F.array_compact(F.array(*turns)).alias("turns"),
    )


def render_context(df: DataFrame, brand_label: str) -> DataFrame:
    """``turns`` as text, oldest first, one ``Speaker: text`` line each, and their number."""
    lines = F.transform(
        F.reverse("turns"),
        lambda t: F.concat(
            F.when(t["is_brand"], F.lit(brand_label)).otherwise(F.lit("Customer")),
            F.lit(": "), t["text"],
        ),
    )
    return df.withColumns(
        {
            "conversation_context": F.array_join(lines, "\n"),
            "context_turn_count": F.size("turns"),
        }
    )


def chain_context(
    tweets: DataFrame, brand: str, n: int = 3, brand_label: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The contextual table: message, reply and the rendered chain above it."""
    rendered = render_context(chain_turns(tweets, brand, n, hot_rows), brand_label or brand)
    return dedup(
        rendered.select(*CONTEXT_COLUMNS),
        ["customer_tweet_id", "brand_tweet_id"],
        ["customer_created_at", "brand_created_at"],
    )


def with_parent_pointer(pairs: DataFrame, tweets: DataFrame) -> DataFrame:
    """Add ``customer_in_response_to``: the pointer of the customer message itself."""
    pointers = dedup(
        tweets.select("tweet_id", "created_at", "in_response_to_tweet_id"),
        ["tweet_id"], ["created_at", "in_response_to_tweet_id"],
    ).select(
        F.col("tweet_id").alias("__id"),
        F.col("in_response_to_tweet_id").alias("customer_in_response_to"),
    )
    return (
        pairs.join(pointers, F.col("customer_tweet_id") == F.col("__id"), "left").drop("__id")
    )


def thread_context(pairs: DataFrame, tweets: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` earlier (customer, brand) turns of the same reply thread.

    The customer message must answer a brand reply that is itself in ``pairs``;
    from there the walk continues at the message that reply answered. One output
    row per pair; ``turns`` runs from the most recent turn back."""
    cur = with_parent_pointer(pairs, tweets)
    prior = cur.select(
        "brand_tweet_id", "customer_tweet_id", "customer_in_response_to",
        tx.trim_text("customer_text").alias("customer_text"),
        tx.trim_text("brand_response").alias("brand_response"),
    )
    walk = cur.withColumns(
        {
            "customer_text": tx.trim_text("customer_text"),
            "brand_response": tx.trim_text("brand_response"),
            "ptr_1": F.col("customer_in_response_to"),
        }
    )
    visited: list[Column] = []
    for h in range(1, n + 1):
        pointer = F.col(f"ptr_{h}")
        live = F.when(~_seen(pointer, visited), pointer) if visited else pointer
        step = prior.select(
            F.col("brand_tweet_id").alias(f"b_id_{h}"),
            F.col("customer_tweet_id").alias(f"c_id_{h}"),
            F.col("customer_text").alias(f"c_text_{h}"),
            F.col("brand_response").alias(f"b_text_{h}"),
            F.col("customer_in_response_to").alias(f"ptr_{h + 1}"),
        )
        walk = (
            walk.withColumn("__key", never_null(live, "brand_tweet_id"))
            .join(step, F.col("__key") == F.col(f"b_id_{h}").cast("string"), "left")
            .drop("__key")
        )
        visited.append(F.col(f"b_id_{h}"))
    turns = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"b_id_{h}").isNotNull(),
                    F.struct(
                        F.col(f"c_text_{h}").alias("customer"),
                        F.col(f"b_text_{h}").alias("brand"),
                        F.col(f"c_id_{h}").alias("customer_tweet_id"),
                        F.col(f"b_id_{h}").alias("brand_tweet_id"),
                    ),
                )
                for h in range(1, n + 1)
            ]
        )
    )
    return walk.select(*pairs.columns, "customer_in_response_to", turns.alias("turns"))


def thread_wide(threads: DataFrame, n: int = 3) -> DataFrame:
    """Flatten ``turns`` to ``prev_<i>_*`` columns (1 = most recent), '' where absent."""
    wide = []
    for i in range(1, n + 1):
        turn = F.try_element_at("turns", F.lit(i))
        for field in ("customer", "brand", "customer_tweet_id", "brand_tweet_id"):
            wide.append(F.coalesce(turn[field], F.lit("")).alias(f"prev_{i}_{field}"))
    keep = [c for c in threads.columns if c != "turns"]
    return threads.select(*keep, *wide, F.size("turns").alias("previous_turn_count"))


def previous_turns_text(n: int = 3, brand_label: str = "Brand") -> Column:
    """The ``prev_*`` columns as lines, most recent turn first."""
    lines = []
    for i in range(1, n + 1):
        for field, label in (("customer", "Customer"), ("brand", brand_label)):
            c = tx.trim_text(tx.text_or_empty(f"prev_{i}_{field}"))
            lines.append(F.when(c != "", F.concat(F.lit(f"{label}: "), c)))
    return F.concat_ws("\n", *lines)


def turn_stats(df: DataFrame, col: str = "context_turn_count") -> DataFrame:
    """Distribution of the number of turns, with the overall mean on every row."""
    counts = df.groupBy(F.col(col).alias("turns")).agg(F.count("*").alias("count"))
    mean = counts.agg(F.sum(F.col("turns") * F.col("count")) / F.sum("count")).scalar()
    return counts.withColumn("mean_turns", F.round(mean, 6))
