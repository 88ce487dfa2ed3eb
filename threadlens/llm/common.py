"""Small pieces that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. For pure ASCII that is ``lower``, which is much cheaper."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column | str) -> Column:
    """Words between blanks, 0 for a null text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed_row(columns: Sequence[str]) -> Column:
    """All of a caller's columns as one struct ``row``, so that none of their names can
    clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")


def unpacked(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"row.`{c}`").alias(c) for c in columns]


def running_total(
    df: DataFrame, order: Sequence[str], value: str, out: str, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``out``: the inclusive running total of ``value`` in ``order``, per ``by``.

    A group may hold any share of the rows. Rows are range-sorted, so that a group lies
    in as many partitions as it needs; each partition sums its own part and starts from
    the totals of the partitions before it. Only those totals (one row per partition
    and group in it) meet in one place.

    The range-sorted rows are stored, since both passes must see the same partitions.
    """
    from threadlens.session import cut_lineage

    ranged = cut_lineage(
        df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    )
    totals = ranged.groupBy("__part", *by).agg(F.sum(value).alias("__sum"))
    earlier = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        F.col("__part").alias("__bpart"), *(F.col(c).alias(f"__b_{c}") for c in by),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"),
    )
    on = F.col("__part") == F.col("__bpart")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    inside = W.partitionBy("__part", *by).orderBy(*order)
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.withColumn(out, F.sum(value).over(inside))
    return (
        local.join(before, on, "left")
        .withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0)))
        .drop("__part", "__bpart", "__before", *(f"__b_{c}" for c in by))
    )
