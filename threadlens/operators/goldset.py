"""Human-label sheets: blank columns, display ids and applying a label map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx

SHEET_COLUMNS = [
    "golden_id", "customer_tweet_id", "brand_tweet_id", "customer_author_id",
    "current_customer_message", "historical_brand_response", "conversation_context",
    "context_turn_count", *lx.GOLD_COLUMNS, "sampling_reason", "candidate_intent",
    "candidate_action", "ambiguity_score", "escalation_flags",
]


def with_seq_id(df: DataFrame, name: str, prefix: str, order: Sequence[Column | str]) -> DataFrame:
    """``PREFIX-0001`` ids in the given order. For finished samples of a few hundred
    rows: numbering needs all rows in one task."""
    nr = F.row_number().over(W.orderBy(*order))
    return df.withColumn(name, F.format_string(f"{prefix}-%04d", nr))


def labeling_template(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add the empty human-label columns, then project the sheet's columns."""
    blank = df.withColumns({c: F.lit("") for c in lx.GOLD_COLUMNS})
    return blank.select(*columns) if columns else blank


def gold_reason(intent: Column, handling: Column) -> Column:
    base = F.coalesce(
        *[F.when(intent == k, F.lit(v)) for k, v in lx.GOLD_REASONS.items()], F.lit("")
    )
    suffix = F.when(handling == "ESCALATE", F.lit(lx.GOLD_REASON_ESCALATE)).otherwise(
        F.lit(lx.GOLD_REASON_AUTO)
    )
    return F.concat(base, suffix)


def apply_gold(sheet: DataFrame, labels: DataFrame) -> DataFrame:
    """Fill the gold_* columns from (golden_id, intent, action, handling, evidence).

    Every label id must match exactly one sheet row; otherwise the job fails and
    names the id. Rows without a label keep what they had."""
    found = sheet.groupBy("golden_id").agg(F.count("*").alias("__n"))
    seen = F.coalesce("__n", F.lit(0))
    checked = labels.join(found, "golden_id", "left").select(
        F.when(seen == 1, F.col("golden_id"))
        .otherwise(
            F.raise_error(
                F.concat(F.col("golden_id"), F.lit(": expected one row, found "),
                         seen.cast("string"))
            )
        )
        .alias("golden_id"),
        F.col("intent").alias("__intent"),
        F.col("action").alias("__action"),
        F.col("handling").alias("__handling"),
        F.col("evidence").alias("__evidence"),
    )
    joined = sheet.join(checked, "golden_id", "left")
    new = {
        "gold_intent": F.col("__intent"),
        "gold_action": F.col("__action"),
        "gold_handling": F.col("__handling"),
        "gold_reason": gold_reason(F.col("__intent"), F.col("__handling")),
        "gold_evidence_sufficient": F.col("__evidence"),
    }
    labelled = F.col("__intent").isNotNull()
    filled = {
        c: F.when(labelled, v).otherwise(F.col(c) if c in sheet.columns else F.lit(None))
        for c, v in new.items()
    }
    return joined.withColumns(filled).drop("__intent", "__action", "__handling", "__evidence")
