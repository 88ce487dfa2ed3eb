"""Readers and input checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.sources.csv_records import read_records

TWEET_COLUMNS = [
    "tweet_id", "author_id", "inbound", "created_at", "text",
    "response_tweet_id", "in_response_to_tweet_id",
]
ID_COLUMNS = ["tweet_id", "response_tweet_id", "in_response_to_tweet_id"]
CASE_SCHEMA = "id string, customer string, intent string, resolution string, brand_reply string"
GOLDEN_SCHEMA = "text string, intent string"


def read_csv_strings(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV with header and quoted multi-line fields, every column a string. A file is
    read by as many tasks as it has byte ranges (``csv_records``)."""
    return read_records(spark, path, columns)


def read_tweets(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Read the message dump. With ``columns`` only those are kept, null as ''. Keep a large
    dump as Parquet (``writers.write_parquet``) if it is read often."""
    df = read_csv_strings(spark, path, TWEET_COLUMNS)
    if columns is None:
        return df
    return df.select([F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def typed_tweets(raw: DataFrame) -> DataFrame:
    """Normalised ids, BOOLEAN inbound, TIMESTAMP created_at; text unchanged."""
    return raw.select(
        tx.norm_id("tweet_id").alias("tweet_id"),
        "author_id",
        tx.as_bool("inbound").alias("inbound"),
        tx.parse_ts("created_at").alias("created_at"),
        "text",
        tx.norm_id("response_tweet_id").alias("response_tweet_id"),
        tx.norm_id("in_response_to_tweet_id").alias("in_response_to_tweet_id"),
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return _json_lines(spark, path, CASE_SCHEMA)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return _json_lines(spark, path, GOLDEN_SCHEMA)


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # Blank lines are skipped by the reader; a malformed line fails the job.
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def first_existing(df: DataFrame, names: Iterable[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def resolve_text_author(df: DataFrame) -> DataFrame:
    """Map whichever text / author column the export has to ``text`` and ``author``."""
    text = first_existing(df, ["text", "tweet", "body"])
    author = first_existing(df, ["author_id", "user_id", "author"])
    if text is None:
        raise ValueError("no text column: expected one of text, tweet, body")
    author_col = F.col(author).cast("string") if author else F.lit("")
    rest = [c for c in df.columns if c not in (text, author)]
    return df.select(
        *rest, tx.text_or_empty(text).alias("text"),
        F.coalesce(author_col, F.lit("")).alias("author"),
    )


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or fail listing every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
