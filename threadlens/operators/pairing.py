"""Pair brand replies with the customer messages they answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.dedup import dedup
from threadlens.operators.profile import brand_replies
from threadlens.operators.sizing import HOT_ROWS, salted_join

PAIR_COLUMNS = [
    "customer_tweet_id", "brand_tweet_id", "customer_author_id", "customer_text",
    "brand_response", "customer_created_at", "brand_created_at",
    "customer_response_tweet_id", "brand_in_response_to",
]


def _replies(tweets: DataFrame, brand: str) -> DataFrame:
    return brand_replies(tweets, brand).select(
        F.col("tweet_id").alias("brand_tweet_id"),
        F.col("text").alias("brand_response"),
        F.col("created_at").alias("brand_created_at"),
        F.col("in_response_to_tweet_id").alias("brand_in_response_to"),
    )


def matched_replies(tweets: DataFrame, brand: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every brand reply beside its parent message, brand-authored parents dropped.

    A message answered by a large share of all replies is salted."""
    parents = tweets.select(
        F.col("tweet_id").alias("customer_tweet_id"),
        F.col("author_id").alias("customer_author_id"),
        F.col("text").alias("customer_text"),
        F.col("created_at").alias("customer_created_at"),
        F.col("response_tweet_id").alias("customer_response_tweet_id"),
        F.col("in_response_to_tweet_id").alias("customer_in_response_to"),
    ).where(~F.col("customer_author_id").eqNullSafe(F.lit(brand)))
    return salted_join(
        _replies(tweets, brand), parents, "brand_in_response_to", "customer_tweet_id",
        row_id=["brand_tweet_id"], how="inner", hot_rows=hot_rows,
    )


def build_pairs(tweets: DataFrame, brand: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Customer message and brand reply, one row per reply."""
    pairs = matched_replies(tweets, brand, hot_rows).select(
        *PAIR_COLUMNS[:3],
        F.coalesce("customer_text", F.lit("")).alias("customer_text"),
        F.coalesce("brand_response", F.lit("")).alias("brand_response"),
        *PAIR_COLUMNS[5:],
    )
    return dedup(
        pairs, ["brand_tweet_id"], ["customer_created_at", "customer_tweet_id"]
    ).select(*PAIR_COLUMNS)


def _reply_parents(tweets: DataFrame, brand: str) -> tuple[DataFrame, DataFrame]:
    replies = brand_replies(tweets, brand).select(
        F.col("tweet_id").alias("brand_tweet_id"),
        F.col("in_response_to_tweet_id").alias("brand_in_response_to"),
    ).where(F.col("brand_in_response_to").isNotNull())
    known = tweets.select(
        F.col("tweet_id").alias("parent_id"), F.col("author_id").alias("parent_author")
    )
    return replies, known


def pair_audit(tweets: DataFrame, brand: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row: matched, missing-parent and brand-parent replies. Replies without a
    parent pointer count nowhere. Only ids and authors are read."""
    replies, known = _reply_parents(tweets, brand)
    joined = salted_join(
        replies, known, "brand_in_response_to", "parent_id", ["brand_tweet_id"], "left", hot_rows
    )
    found = F.col("parent_id").isNotNull()
    by_brand = F.col("parent_author").eqNullSafe(F.lit(brand))
    return joined.agg(
        F.count_if(found & ~by_brand).alias("matched"),
        F.count_if(~found).alias("missing_parent"),
        F.count_if(found & by_brand).alias("brand_parent"),
    )


def orphan_replies(tweets: DataFrame, brand: str) -> DataFrame:
    """Replies that point at a message which is not in the data."""
    replies, known = _reply_parents(tweets, brand)
    return replies.join(
        known, F.col("brand_in_response_to") == F.col("parent_id"), "left_anti"
    )
