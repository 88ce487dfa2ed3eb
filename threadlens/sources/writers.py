"""Sinks. Every writer leaves one file per task; nothing is coalesced to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header. Array columns are joined with '; '. Quotes inside a field
    are doubled so that multi-line text reads back unchanged."""
    flat = df.select(
        [
            F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.col(c)
            for c, t in df.dtypes
        ]
    )
    flat.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="",
                              ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def json_rows(df: DataFrame, key: Column | str, text: str = "text",
              author: str = "author") -> DataFrame:
    """(row_id, text, author) records; row_id is a key, files have no row order."""
    key = F.col(key) if isinstance(key, str) else key
    return df.select(key.alias("row_id"), F.col(text).alias("text"), F.col(author).alias("author"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def metrics_to_json(metrics: DataFrame) -> DataFrame:
    """Nest a long (section, key, value) metrics table into one JSON text.

    The table has one row per metric, a few hundred at most, so gathering it in
    one group is bounded by the number of metrics and not by the data."""
    sections = metrics.groupBy("section").agg(
        F.sort_array(F.collect_list(F.struct("key", "value"))).alias("entries")
    )
    ordered = F.sort_array(F.collect_list(F.struct("section", "entries")))
    nested = F.transform(
        ordered, lambda s: F.struct(s["section"], F.map_from_entries(s["entries"]))
    )
    return sections.agg(F.to_json(F.map_from_entries(nested)).alias("json"))


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    metrics_to_json(metrics).write.mode("overwrite").text(path)
