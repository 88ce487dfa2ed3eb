"""Account activity and brand filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_mention(df: DataFrame, brand: str, col: str = "text") -> DataFrame:
    """Rows whose text contains the brand literally, in any case."""
    return df.where(F.contains(F.lower(col), F.lit(brand.lower())))


def filter_author(df: DataFrame, author: str) -> DataFrame:
    return df.where(F.col("author_id") == author)


def is_brand_reply(brand: str) -> Column:
    return (F.col("author_id") == brand) & ~F.col("inbound")


def brand_replies(tweets: DataFrame, brand: str) -> DataFrame:
    return tweets.where(is_brand_reply(brand))


def account_counts(tweets: DataFrame) -> DataFrame:
    """Messages per account; counts are combined before the shuffle."""
    return (
        tweets.where(F.col("author_id").isNotNull())
        .groupBy(F.col("author_id").alias("brand_author_id"))
        .agg(
            F.count("*").alias("total_tweets"),
            F.count_if("inbound").alias("inbound_tweets"),
            F.count_if(~F.col("inbound")).alias("outbound_tweets"),
        )
    )


def brand_activity(tweets: DataFrame, min_outbound: int = 500) -> DataFrame:
    """Accounts with enough outbound messages, with their outbound ratio."""
    return (
        account_counts(tweets)
        .where(F.col("outbound_tweets") >= min_outbound)
        .withColumn("outbound_ratio", F.round(F.col("outbound_tweets") / F.col("total_tweets"), 3))
    )


def top_accounts(activity: DataFrame, n: int = 50) -> DataFrame:
    return activity.orderBy(
        F.desc("outbound_tweets"), F.desc("total_tweets"), "brand_author_id"
    ).limit(n)


def brand_summary(tweets: DataFrame, brand: str) -> DataFrame:
    return filter_author(tweets, brand).agg(
        F.count("*").alias("total_tweets"),
        F.count_if(~F.col("inbound")).alias("replies"),
        F.count_if("inbound").alias("inbound_tweets"),
    )
