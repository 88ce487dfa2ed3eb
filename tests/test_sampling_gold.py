import pytest
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.operators import dedup, goldset, sampling

V2_INTENTS = list(lx.V2_QUOTAS)


def labelled_v2(spark, n):
    """n distinct messages with intents, flags and ambiguity spread by arithmetic."""
    i = F.col("id")
    names = F.array(*[F.lit(x) for x in [*V2_INTENTS, "unknown", "ambiguous"]])
    return spark.range(n).select(
        i.cast("string").alias("customer_tweet_id"),
        F.concat(F.lit("b"), i).alias("brand_tweet_id"),
        F.concat(F.lit("text "), i).alias("current_customer_message"),
        F.element_at(names, (F.pmod(i * 7, F.lit(12)) + 1).cast("int")).alias("candidate_intent"),
        F.pmod(i, F.lit(4)).cast("int").alias("context_turn_count"),
        F.when(i % 9 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(
            F.array().cast("array<string>")
        ).alias("escalation_flags"),
        (i % 9 == 0).alias("escalation_candidate"),
        F.when(i % 5 == 0, 4).otherwise(F.pmod(i, F.lit(2)) * 2).cast("int").alias("ambiguity_score"),
        (i % 5 == 0).alias("ambiguity_candidate"),
        F.timestamp_seconds(i).alias("customer_created_at"),
    )


def test_golden_sample_is_exact(spark):
    df = labelled_v2(spark, 6000)
    golden = sampling.golden_sample_v2(df, prefix="T").cache()
    assert golden.count() == 200
    assert golden.select("customer_tweet_id").distinct().count() == 200
    assert {r.golden_id for r in golden.select("golden_id").collect()} == {
        f"T-{i:04d}" for i in range(1, 201)
    }
    plain = golden.where("not ambiguity_candidate and not escalation_candidate")
    counts = dict(plain.groupBy("candidate_intent").count().collect())
    assert counts == lx.V2_QUOTAS
    assert golden.where("ambiguity_candidate").count() == 15
    assert golden.where("escalation_candidate and not ambiguity_candidate").count() == 15
    backup = sampling.backup_pool_v2(df, golden)
    assert backup.count() == 600
    assert backup.join(golden, "customer_tweet_id", "left_semi").count() == 0
    again = sampling.golden_sample_v2(df, prefix="T")
    assert again.exceptAll(golden).count() == 0


def test_small_buckets_are_filled_up(spark):
    df = labelled_v2(spark, 150)
    golden = sampling.golden_sample_v2(df)
    assert golden.count() == 150  # everything, once
    df = labelled_v2(spark, 260).where("candidate_intent <> 'delivery' or customer_tweet_id < '3'")
    golden = sampling.golden_sample_v2(df)
    assert golden.count() == min(200, df.count())


def labelled_v1(spark, n):
    i = F.col("id")
    return spark.range(n).select(
        i.cast("string").alias("customer_tweet_id"), F.concat(F.lit("b"), i).alias("brand_tweet_id"),
        F.when(i % 50 == 0, "order").otherwise("delivery").alias("candidate_intent"),
        F.pmod(i, F.lit(3)).cast("int").alias("context_turn_count"),
        F.pmod(i, F.lit(6)).cast("int").alias("ambiguity_score"),
        F.when(i % 4 == 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("signals"),
        F.when(i % 4 == 0, "s").otherwise("").alias("escalation_signals"),
    )


def test_review_pool(spark):
    df = labelled_v1(spark, 1000)  # "order" has 20 rows, "delivery" 980
    pool = sampling.review_pool_v1(df).cache()
    assert pool.where("candidate_intent = 'order'").count() == 20
    delivery = pool.where("candidate_intent = 'delivery'").count()
    assert 60 <= delivery <= 180
    assert pool.dropDuplicates(["customer_tweet_id", "brand_tweet_id"]).count() == pool.count()
    orders = sorted(r.pool_order for r in pool.select("pool_order").collect())
    assert orders == list(range(1, pool.count() + 1))
    assert sampling.review_pool_v1(df, compat=True).count() == pool.count()


def test_group_limit_runs_before_the_shuffle(spark):
    plan = sampling.bucket_candidates_v1(labelled_v1(spark, 100))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan"):]
    assert physical.count("WindowGroupLimit") == 2


def test_splits_do_not_leak(spark):
    df = spark.range(3000).select("id", F.pmod("id", F.lit(97)).alias("g"))
    for split in (sampling.group_split(df, "g"), sampling.group_split_exact(df, "g")):
        train, val = split.where("split = 'train'"), split.where("split = 'validation'")
        assert train.count() + val.count() == 3000
        assert dedup.group_overlap(train, val, "g").first()[0] == 0
    exact = sampling.group_split_exact(df, "g").where("split = 'validation'")
    assert exact.select("g").distinct().count() == 15  # ceil(0.15 x 97)


def sheet(spark, ids):
    df = spark.createDataFrame([(x,) for x in ids], "golden_id string")
    return goldset.labeling_template(df)


def labels(spark, *ids):
    return spark.createDataFrame(
        [(i, "delivery", "phone_chat", "ESCALATE", "YES") for i in ids],
        "golden_id string, intent string, action string, handling string, evidence string",
    )


def test_apply_gold(spark):
    out = goldset.apply_gold(sheet(spark, ["G-1", "G-2"]), labels(spark, "G-1"))
    got = {r.golden_id: r for r in out.collect()}
    assert got["G-1"].gold_intent == "delivery"
    assert got["G-1"].gold_reason == lx.GOLD_REASONS["delivery"] + lx.GOLD_REASON_ESCALATE
    assert got["G-2"].gold_intent == ""


@pytest.mark.parametrize("ids", [["G-1", "G-1"], ["G-2"]])
def test_apply_gold_needs_one_row_per_id(spark, ids):
    with pytest.raises(Exception, match="G-1: expected one row"):
        goldset.apply_gold(sheet(spark, ids), labels(spark, "G-1")).collect()


def test_ranked_buckets_by_one_window_or_by_salted_parts(spark):
    """A limit beyond Spark's threshold is applied to salted parts first: the same rows."""
    rows = [(str(i), f"b{i}", "hot" if i % 3 else "cold", (i * 37) % 11) for i in range(900)]
    df = spark.createDataFrame(rows, "customer_tweet_id string, brand_tweet_id string, g string, x int")
    buckets = F.array(
        sampling._entry("a", F.col("g"), -F.col("x")), F.when(F.col("x") > 5, sampling._entry("b", "", F.col("x")))
    )
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    found = []
    for threshold in ("1000", "1"):
        spark.conf.set(key, threshold)
        try:
            ranked = sampling._ranked_buckets(df, buckets, {"a": 20, "b": 7})
            found.append(sorted(tuple(r) for r in ranked.collect()))
        finally:
            spark.conf.unset(key)
    assert found[0] == found[1] and len(found[0]) == 47
