"""Views of the test tables in the shapes the operators expect.

The tables hold invented prose, which phrase rules hardly ever hit, so every text
gets one phrase from a fixed list appended. The SQL twins are in ``sql.py``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.operators import pairing, threads

BRAND = "brand"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

USER_PHRASES = [
    "",
    "cancel my order please, wrong address",
    "I want a refund, item arrived damaged @shop",
    "my card was charged twice!! https://pay.example.com/x?a=1",
    "can't login, password reset is broken #help",
    "my kindle is not working &amp; the screen is black",
    "worst customer service, I want to speak to someone",
    "package not delivered but tracking says delivered",
    "where is my order? still waiting",
    "do you offer two day shipping options",
    "how do i find more information",
    "still no luck, already tried everything",
    "this is ridiculous and unacceptable",
    "it is still not working again",
    "can’t access my account – it’s locked out",
    "RT @someone: delivery delayed www.track.example.org/123",
    "please call me, I need a human agent",
    "close my account or I call my lawyer",
    "never arrived, missing package",
    "thanks",
    "ok that is it",
    "refund or replacement for the broken echo",
    "payment failed, order status unknown",
]
BRAND_PHRASES = [
    "Sorry for the trouble, please check out our help page https://help.example.com/a",
    "We will look into this, thanks for waiting",
    "Please contact us by phone or chat: https://chat.example.com",
    "Request a callback and we call you back",
    "You can get a refund or a replacement",
    "Thank you, glad to help!",
    "We are unable to view personal information via Twitter",
    "Your estimated delivery information is available",
    "",
    "Fill out this form; our agent will investigate",
    "We apologise",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over the cores: the small test files are one row group
    each, which a scan cannot split. Large files are cut finer than they are scanned, so
    that no task's share of the long texts grows with the table."""
    found = table(spark, sf_dir, "documents")
    parts = max(spark.sparkContext.defaultParallelism, 4 * found.rdd.getNumPartitions())
    return found.repartition(parts)


def phrase(phrases: list[str], position: Column) -> Column:
    listed = F.split(F.lit("\n".join(phrases)), "\n")
    return F.element_at(listed, (F.lit(1) + position % len(phrases)).cast("int"))


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reply chains; a customer owns three conversations."""
    return conversation_tweets(table(spark, sf_dir, "conversations"))


def conversation_tweets(c: DataFrame) -> DataFrame:
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    at = conv * 31 + turn * 7
    added = F.when(role == "assistant", phrase(BRAND_PHRASES, at)).otherwise(
        phrase(USER_PHRASES, at)
    )
    author = (
        F.when(role == "assistant", BRAND)
        .when(role == "system", "system")
        .otherwise(F.concat(F.lit("c"), F.floor(conv / 3).cast("string")))
    )
    return c.select(
        (conv * 100 + turn).cast("string").alias("tweet_id"),
        author.alias("author_id"),
        (role != "assistant").alias("inbound"),
        F.timestamp_seconds(F.lit(1509487200) + conv * 60 + turn).alias("created_at"),
        F.concat("text", F.lit(" "), added).alias("text"),
        (conv * 100 + turn + 1).cast("string").alias("response_tweet_id"),
        F.when(turn > 0, (conv * 100 + turn - 1).cast("string")).alias("in_response_to_tweet_id"),
    )


def event_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a reply graph: event n answers event n - k with k from its props.

    Purchases are the brand's. Sign-ups open threads; k = 0 answers itself and a
    pointer before the first event is missing."""
    e = table(spark, sf_dir, "events")
    back = F.get_json_object("props", "$.k").cast("long")
    is_brand = F.col("event_type") == "purchase"
    return e.select(
        F.col("event_id").cast("string").alias("tweet_id"),
        F.when(is_brand, BRAND)
        .otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
        .alias("author_id"),
        (~is_brand).alias("inbound"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
        F.lit(None).cast("string").alias("response_tweet_id"),
        F.when(F.col("event_type") != "signup", (F.col("event_id") - back).cast("string")).alias(
            "in_response_to_tweet_id"
        ),
    )


def raw_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation view as it would arrive: strings, '.0' ids, 'True'/'False'."""
    return tweets(spark, sf_dir).select(
        "tweet_id", "author_id",
        F.when(F.col("inbound"), "True").otherwise("False").alias("inbound"),
        F.date_format("created_at", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"),
        "text", "response_tweet_id",
        F.concat("in_response_to_tweet_id", F.lit(".0")).alias("in_response_to_tweet_id"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.build_pairs(tweets(spark, sf_dir), BRAND)


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as single-turn messages with a canned reply."""
    d = documents(spark, sf_dir)
    at = F.col("doc_id") * 31
    message = tx.squash_ws(F.concat("text", F.lit(" "), phrase(USER_PHRASES, at)))
    doc = F.col("doc_id").cast("string")
    return d.select(
        F.concat(F.lit("d"), doc).alias("customer_tweet_id"),
        F.concat(F.lit("r"), doc).alias("brand_tweet_id"),
        F.concat(F.lit("a"), F.col("source")).alias("customer_author_id"),
        message.alias("current_customer_message"),
        tx.squash_ws(phrase(BRAND_PHRASES, at)).alias("historical_brand_response"),
        F.concat(F.lit("Customer: "), message).alias("conversation_context"),
        F.lit(1).alias("context_turn_count"),
        F.timestamp_seconds(F.lit(1600000000) + F.col("doc_id")).alias("customer_created_at"),
        F.timestamp_seconds(F.lit(1600000001) + F.col("doc_id")).alias("brand_created_at"),
    )


def contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation messages with their chain, and whole documents."""
    chain = threads.chain_context(tweets(spark, sf_dir), BRAND)
    return chain.unionByName(document_messages(spark, sf_dir))
