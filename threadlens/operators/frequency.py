"""Counts, shares and cross-tabs of label columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.session import cut_lineage

BINS = 4_096
FEW = 200_000  # values that the driver sorts at the end of a median
_SKETCH_SIZE, _RANK_ERROR = 2_048, 0.01  # ranks from such a sketch are within 0.3 %


def frequency(df: DataFrame, col: str) -> DataFrame:
    """Rows per value and their share in percent."""
    counts = df.groupBy(col).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn(
        "percentage", F.round(F.col("count") / total * F.lit(100e0), 2)
    )


def crosstab_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, count, percentage within the row); only combinations that occur."""
    counts = df.groupBy(row, col).agg(F.count("*").alias("count"))
    within = F.sum("count").over(W.partitionBy(row))
    return counts.withColumn("percentage", F.round(F.col("count") / within * F.lit(100e0), 2))


def crosstab_pct(df: DataFrame, row: str, col: str, labels: Sequence[str]) -> DataFrame:
    """Row-normalised percentages, one column per known label, 0 where absent."""
    per_label = [F.count_if(F.col(col) == x) for x in labels]
    return df.groupBy(row).agg(
        *[
            F.round(c / F.count("*") * F.lit(100e0), 2).alias(x)
            for c, x in zip(per_label, labels)
        ]
    )


def label_counts(df: DataFrame, labels: str, name: str = "signal") -> DataFrame:
    """Occurrences of each label of an array column."""
    return df.select(F.explode(labels).alias(name)).groupBy(name).agg(F.count("*").alias("count"))


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Distinct non-null values; ``approx`` trades exactness for one light pass."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(fn(col).alias("distinct_count"))


def flag_share(df: DataFrame, flag: str) -> DataFrame:
    """Number and percentage of flagged rows."""
    return df.agg(
        F.count_if(flag).alias("flagged"),
        F.round(F.avg(F.col(flag).cast("double")) * F.lit(100e0), 2).alias("percentage"),
    )


def exact_median(df: DataFrame, col: str, few: int = FEW, bins: int = BINS) -> float | None:
    """The median, midpoint of the two middle values for an even count; null and NaN do
    not count. The built-in exact median keeps every distinct value in one task; here a
    mergeable sketch brackets the middle, and the next pass counts what lies below the
    bracket and sketches what lies in it, until at most ``few`` values are left to sort.
    A million rows take two passes over one stored column, a billion three."""
    v = F.col(col).cast("double")
    values = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    values = cut_lineage(values)
    inside, sketch = values.agg(F.count("*"), _sketch(F.col("v"))).first()
    if inside == 0:
        return None
    ranks = ((inside - 1) // 2, inside // 2)
    low, high, below = float("-inf"), float("inf"), 0
    while inside > few:
        at = [(r - below) / inside for r in ranks]
        ends = F.array(F.lit(max(at[0] - _RANK_ERROR, 0.0)), F.lit(min(at[1] + _RANK_ERROR, 1.0)))
        low, high = values.sparkSession.range(1).select(
            F.kll_sketch_get_quantile_double(F.lit(sketch), ends)
        ).first()[0]
        within = F.col("v").between(low, high)
        under, now, sketch = values.agg(
            F.count_if(F.col("v") < low), F.count_if(within), _sketch(F.when(within, F.col("v")))
        ).first()
        held = under <= ranks[0] and ranks[1] < under + now
        if held and low == high:
            return low
        if not held or now > inside / 2:  # a bracket that missed, or values that repeat
            found = [_value_at(values, r, bins) for r in ranks]
            return found[0] if found[0] == found[1] else sum(found) / 2
        inside, below = now, under
    counts = values.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n"))
    found, upto = [], below
    for r in sorted(counts.collect(), key=lambda r: r["v"]):  # ``few`` at most
        upto += r["n"]
        found += [r["v"]] * sum(1 for x in ranks[len(found) :] if x < upto)
        if len(found) == 2:
            break
    return found[0] if found[0] == found[1] else sum(found) / 2


def _sketch(v: Column) -> Column:
    return F.kll_sketch_agg_double(v, _SKETCH_SIZE)


def _value_at(values: DataFrame, rank: int, bins: int) -> float:
    """The value of a rank from 0. Equal bins between the smallest and the largest value
    are counted, and the bin that holds the rank is cut again until it is one value."""
    v = F.col("v")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        width = high / bins - low / bins
        # Too narrow for bins: fewer different doubles than bins are left.
        place = F.least(F.floor((v - low) / width), F.lit(bins - 1)) if low + width > low else v
        counted = values.where(v.between(low, high)).groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        before = values.where(v < low).count()
        for r in sorted(counted.collect(), key=lambda r: r["low"]):
            if before + r["n"] > rank:
                low, high = r["low"], r["high"]
                break
            before += r["n"]
    return low


def confidence_stats(df: DataFrame, col: str) -> DataFrame:
    """Mean, median, minimum and maximum, to six places."""
    median = exact_median(df, col)
    return df.agg(
        F.round(F.avg(col), 6).alias("mean"),
        F.round(F.lit(median).cast("double"), 6).alias("median"),
        F.round(F.min(col), 6).alias("min"),
        F.round(F.max(col), 6).alias("max"),
    )


def missing_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count per column, as (label_column, missing) rows."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "label_column", "missing")
