"""Concatenation, deduplication and set checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.rules import computed


def concat_parts(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """Keep the first (or last) row per key by an explicit order.

    Runs as min_by/max_by, so copies are folded on the map side and a key that
    owns a third of the rows still reaches its reducer as one row per task.
    ``order`` must decide ties; null sorts last either way round."""
    flagged: list[Column] = []
    for name in order:
        missing = F.col(name).isNull()
        flagged += [missing, F.col(name)]
    pick = F.max_by if last else F.min_by
    row = F.struct(*[c for c in df.columns if c not in keys])
    kept = df.groupBy(*keys).agg(pick(row, F.struct(*flagged)).alias("__row"))
    return kept.select(*keys, "__row.*").select(*df.columns)


def dedup_text(
    df: DataFrame, clean: Column, order: Sequence[str], name: str = "clean_text",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Drop rows whose cleaned text is empty and keep the first row per cleaned text. A text
    that is in column ``name`` already is not cleaned again.

    Texts are told apart by their sha256, so that no whole text is sorted; ``columns`` names
    those to keep, the texts themselves are not shuffled if they are not among them."""
    cleaned = df if name in df.columns else computed(df, {name: clean})
    key = F.sha2(F.col(name), 256).alias("__key")
    kept = [*dict.fromkeys([*(columns or cleaned.columns), *order])]
    rows = cleaned.where(F.length(name) > 0).select(key, *kept)
    return dedup(rows, ["__key"], order).select(*(columns or cleaned.columns))


def group_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys occur on both sides (0 for a leakage-free split)."""
    shared = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
    return shared.agg(F.count("*").alias("overlapping"))


def exclude(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return df.join(chosen.select(key), key, "left_anti")
