"""The two classifier baselines: message only, and message with customer history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators import history, labelling, models, sampling
from threadlens.operators.features import BASELINE, TermSettings
from threadlens.session import cut_lineage


def silver_split(pairs: DataFrame, fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """Usable silver rows with a customer-grouped ``split``."""
    return sampling.group_split(
        labelling.usable_silver(pairs), "customer_author_id", fraction, seed
    )


def run_baseline(
    split: DataFrame, text: str = "customer_text", settings: TermSettings = BASELINE,
    max_iter: int = 1000,
) -> DataFrame:
    """Fit on the training split, score the validation split."""
    split = cut_lineage(split.select("brand_tweet_id", text, "silver_intent", "split"))
    train = split.where(F.col("split") == "train").drop("split")
    validation = split.where(F.col("split") == "validation").drop("split")
    model = models.fit_intent(train, "brand_tweet_id", text, "silver_intent", settings, max_iter)
    return model.score(validation, "brand_tweet_id", text)


def run_context_baseline(
    pairs: DataFrame, split: DataFrame, brand_label: str = "Brand",
    settings: TermSettings = BASELINE, max_iter: int = 1000,
) -> DataFrame:
    """The same model on the customer's previous turns plus the message."""
    context = history.customer_history(pairs, brand_label=brand_label)
    attached = history.attach_context(split, context)
    return run_baseline(attached, "context_text", settings, max_iter)
