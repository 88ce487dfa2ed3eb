"""Whole texts are neither keys of a deduplication nor ranked."""

from pyspark.sql import functions as F

from threadlens.operators import dedup
from threadlens.suite import QUERIES


def test_whole_texts_are_not_the_key_of_a_deduplication(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c"), (4, "")], "id int, t string")
    kept = dedup.dedup_text(df, F.lower("t"), ["id"], columns=["id"])
    assert sorted(r.id for r in kept.collect()) == [1, 3]
    shuffled = [
        line for line in kept._jdf.queryExecution().executedPlan().toString().splitlines()
        if "Exchange hashpartitioning" in line
    ]
    assert shuffled and all("clean_text" not in line for line in shuffled)


def test_ranked_examples_hold_previews_only(spark, tmp_path):
    spark.createDataFrame(
        [(1, 0, "user", "cancel my order " + "x" * 400), (1, 1, "assistant", "ok " * 200)],
        "conv_id long, turn long, role string, text string",
    ).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(
        [(7, "refund my order " + "y" * 400, "en", "s")],
        "doc_id long, text string, lang string, source string",
    ).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["wn3_examples_per_label"](spark, str(tmp_path))
    assert sorted(len(r.customer_preview) for r in df.collect()) == [300, 300]
    plan = df._jdf.queryExecution().executedPlan().toString()
    ranked = plan[: plan.index("WindowGroupLimit")]
    assert "current_customer_message" not in ranked
    assert "current_customer_message" in plan  # after the ranking, before
