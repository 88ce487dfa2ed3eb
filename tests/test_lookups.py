"""Rule sets share one reading of a text; documents are cut by their size."""

import re

import pytest
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.operators import labelling, sampling
from threadlens.suite import fixtures as fx

COLUMNS = [
    "customer_tweet_id", "brand_tweet_id", "current_customer_message", "conversation_context",
    "historical_brand_response", "context_turn_count", "customer_created_at",
]
ROWS = [
    ("1", "2", "Refund my broken order!! www.a.b/c", "brand: sorry, contact us", "please call us", 1, 5),
    ("3", "4", "still not working @x #y", "Customer: refund please", None, 2, 6),
    ("5", "6", None, None, "", 0, 7),
    ("7", "8", "  refund my broken ORDER", "", "ok", 1, 1),
]


def _table(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in COLUMNS[:5])
                                 + ", context_turn_count int, customer_created_at int")


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    ("label", "texts"),
    [(labelling.label_analysis, 3), (labelling.label_v1, 2), (labelling.label_v2, 3)],
)
def test_a_text_is_read_once_for_all_rule_sets(spark, label, texts):
    calls = re.findall(r"find\([^)]*\)#\d+", _plan(label(_table(spark))))
    assert len(set(calls)) <= texts


def test_labels_of_parts_agree_with_all(spark):
    df = _table(spark)
    for label, parts in (
        (labelling.label_analysis, ("intent", "action", "signals", "ambiguous")),
        (labelling.label_v1, ("intent", "action", "signals", "ambiguity")),
        (labelling.label_v2, ("intent", "action", "flags", "ambiguity")),
    ):
        whole = {r["brand_tweet_id"]: r for r in label(df).collect()}
        for part in parts:
            for r in label(df, [part]).collect():
                assert all(whole[r["brand_tweet_id"]][c] == v for c, v in r.asDict().items())


def test_both_texts_cleaned_apart_are_as_cleaned_together(spark):
    df = _table(spark)
    apart = F.lower(
        F.trim(F.concat(
            tx.clean_basic("conversation_context"), F.lit(" "),
            tx.clean_basic("current_customer_message"),
        ))
    )
    rows = df.select(labelling.analysis_text().alias("a"), apart.alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_the_cleaned_message_is_kept_for_the_deduplication(spark):
    df = _table(spark)
    kept = sampling.distinct_messages_v2(labelling.label_v2(df, cleaned="clean_current"))
    again = sampling.distinct_messages_v2(labelling.label_v2(df))
    assert sorted(map(str, kept.select(*again.columns).collect())) == sorted(map(str, again.collect()))
    assert {r.brand_tweet_id for r in kept.collect()} == {"8", "4"}


@pytest.mark.parametrize("text", [
    "hhttp://a.b c", "see https://x.y/z?q=1 and www.a.b/c.", "www. http:// wwww.d http", "awww.e",
    "https://www.f", "ww.g h w", "",
])
def test_quick_urls_are_the_urls(spark, text):
    df = spark.createDataFrame([(text,)], "c string")
    a, b = df.select(
        *(F.regexp_replace("c", F.lit(p), F.lit(" ")) for p in (tx.URL_WWW, tx.URL_WWW_QUICK))
    ).first()
    assert a == b


@pytest.mark.parametrize("text", [
    None, "", " ", "a", " a", "a b", "a  b\u00a0c ", "\tone\ntwo three four", "x" * 5000, "\U0001f600 b c d",
])
def test_more_words_as_counted(spark, text):
    df = spark.createDataFrame([(text,)], "c string")
    n, *more = df.select(tx.n_words("c"), *(tx.more_words("c", i) for i in range(5))).first()
    assert more == [n > i for i in range(5)]


def test_documents_are_cut_by_their_size(spark, tmp_path):
    spark.range(64).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(
        64
    ).write.parquet(f"{tmp_path}/documents.parquet")
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        parts = fx.documents(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert parts > 100  # 8, whatever the size, before
