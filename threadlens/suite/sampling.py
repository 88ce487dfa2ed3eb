"""Queries: extracts, splits and stratified samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.operators import evaluation, labelling, sampling
from threadlens.session import cut_lineage
from threadlens.suite import fixtures as fx
from threadlens.suite import sql as q
from threadlens.suite.base import query
from threadlens.suite.io_text import GOLD_PRED, gold_and_pred

_IDS = "customer_tweet_id, brand_tweet_id"
_V1 = q.with_(q.CONTEXTUAL, q.V1)


def _v1(spark, sf):
    return labelling.label_v1(
        fx.contextual(spark, sf), ["intent", "signals", "ambiguity"]
    )


@query(
    "wn4_bucket_candidates_v1",
    _V1
    + f"SELECT candidate_intent, {_IDS}, review_priority::INTEGER AS review_priority, "
    "rn::INTEGER AS review_rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate_intent "
    f"ORDER BY review_priority DESC, {_IDS}) AS rn FROM (SELECT *, ambiguity_score + "
    "greatest(len(sig) - 1, 0) + context_turn_count AS review_priority FROM v1)) WHERE rn <= 60",
)
def _wn4(spark, sf):
    return sampling.bucket_candidates_v1(_v1(spark, sf)).select(
        "candidate_intent", *sampling.PAIR_IDS, "review_priority", "review_rank"
    )


@query(
    "sl3_extracts_v1",
    _V1
    + f"(SELECT 'ambiguous' AS extract, {_IDS} FROM v1 WHERE ambiguity_score >= 2 ORDER BY "
    f"ambiguity_score DESC, context_turn_count DESC, {_IDS} LIMIT 100) UNION ALL "
    f"(SELECT 'escalation', {_IDS} FROM v1 WHERE len(sig) > 0 ORDER BY len(sig) DESC, {_IDS} LIMIT 100)",
)
def _sl3(spark, sf):
    df = _v1(spark, sf)
    ids = sampling.PAIR_IDS
    a = sampling.ambiguous_extract_v1(df).select(F.lit("ambiguous").alias("extract"), *ids)
    b = sampling.escalation_extract_v1(df).select(F.lit("escalation").alias("extract"), *ids)
    return a.unionByName(b)


@query(
    "sl4_extracts_v2",
    q.with_(q.CONTEXTUAL, q.V2)
    + f"SELECT candidate_intent AS extract, {_IDS}, candidate_score AS sort_1, ambiguity_score AS "
    "sort_2 FROM v2d WHERE candidate_intent NOT IN ('unknown', 'ambiguous') UNION ALL "
    f"SELECT 'ambiguous', {_IDS}, ambiguity_score, 0 FROM v2d WHERE ambiguity_candidate UNION ALL "
    f"SELECT 'escalation', {_IDS}, ambiguity_score, 0 FROM v2d WHERE escalation_candidate UNION ALL "
    f"SELECT 'unknown_or_ambiguous', {_IDS}, ambiguity_score, 0 FROM v2d "
    "WHERE candidate_intent IN ('unknown', 'ambiguous')",
)
def _sl4(spark, sf):
    return sampling.extracts_v2(distinct_v2(spark, sf)).select(
        "extract", *sampling.PAIR_IDS, "sort_1", "sort_2"
    )


def distinct_v2(spark, sf):
    df = labelling.label_v2(
        fx.contextual(spark, sf), ["intent", "flags", "ambiguity"], cleaned="clean_current"
    )
    # What the samples are drawn by: whole texts would be shuffled and stored for nothing.
    return sampling.distinct_messages_v2(
        df,
        [
            *sampling.PAIR_IDS, "customer_created_at", "context_turn_count", "candidate_intent",
            "candidate_score", "escalation_flags", "escalation_candidate", "ambiguity_score",
            "ambiguity_candidate",
        ],
    )


# -- splits -------------------------------------------------------------------

_CUT = int(0.15 * 16**8)


def _pos(key: str) -> str:
    return f"CAST('0x' || substr({q.seeded(42, key)}, 1, 8) AS BIGINT)"


@query(
    "sp1_group_split",
    f"SELECT o_orderkey, CASE WHEN {_pos('o_custkey')} < {_CUT} THEN 'validation' ELSE 'train' END "
    "AS split FROM orders",
)
def _sp1(spark, sf):
    orders = fx.table(spark, sf, "orders")
    return sampling.group_split(orders, "o_custkey").select("o_orderkey", "split")


@query(
    "sp1_group_split_exact",
    f"WITH g AS (SELECT o_custkey, {q.seeded(42, 'o_custkey')} AS h FROM (SELECT DISTINCT o_custkey "
    "FROM orders)), r AS (SELECT o_custkey, row_number() OVER (ORDER BY h, o_custkey) AS rn FROM g) "
    "SELECT o_orderkey, CASE WHEN rn <= (SELECT ceil(count(*) * 0.15e0) FROM g) THEN 'validation' "
    "ELSE 'train' END AS split FROM orders JOIN r USING (o_custkey)",
)
def _sp1x(spark, sf):
    orders = fx.table(spark, sf, "orders")
    return sampling.group_split_exact(orders, "o_custkey").select("o_orderkey", "split")


# -- stratified samples -------------------------------------------------------

_RANDOM = q.seeded(42, "customer_tweet_id", "brand_tweet_id")


@query(
    "sp2_review_pool_v1",
    _V1
    + f"""SELECT {_IDS}, row_number() OVER (ORDER BY
    {q.seeded(43, 'customer_tweet_id', 'brand_tweet_id')}, {_IDS})::INTEGER AS pool_order
FROM (
  SELECT {_IDS} FROM (
    SELECT *, row_number() OVER (PARTITION BY candidate_intent, hard_rank <= 30
      ORDER BY {_RANDOM}, {_IDS}) AS random_rank
    FROM (
      SELECT *, row_number() OVER (PARTITION BY candidate_intent ORDER BY
        context_turn_count * 2 + ambiguity_score + len(sig) DESC, {_IDS}) AS hard_rank
      FROM v1))
  WHERE hard_rank <= 30 OR random_rank <= 30
  UNION
  (SELECT {_IDS} FROM v1 WHERE ambiguity_score >= 2
   ORDER BY ambiguity_score DESC, context_turn_count DESC, {_IDS} LIMIT 60)
  UNION
  (SELECT {_IDS} FROM v1 WHERE len(sig) > 0 ORDER BY len(sig) DESC, {_IDS} LIMIT 60))""",
)
def _sp2(spark, sf):
    labelled = cut_lineage(_v1(spark, sf))
    return sampling.review_pool_v1(labelled).select(*sampling.PAIR_IDS, "pool_order")


_QUOTA = "CASE candidate_intent " + " ".join(
    f"WHEN {q.lit(k)} THEN {v}" for k, v in lx.V2_QUOTAS.items()
) + " END"
_HARD = "CASE candidate_intent " + " ".join(
    f"WHEN {q.lit(k)} THEN {max(1, round(v * 0.4))}" for k, v in lx.V2_QUOTAS.items()
) + " END"
_BUCKET = f"list_position({q.lits(list(lx.V2_QUOTAS))}, candidate_intent)"

_GOLDEN = f"""plain AS (
  SELECT *, row_number() OVER (PARTITION BY candidate_intent ORDER BY
    ambiguity_score + (context_turn_count >= 2)::INTEGER DESC, {_IDS}) AS hard_rank
  FROM v2d WHERE NOT ambiguity_candidate AND NOT escalation_candidate
    AND candidate_intent NOT IN ('unknown', 'ambiguous')),
balanced AS (
  SELECT *, row_number() OVER (PARTITION BY candidate_intent, hard_rank <= {_HARD}
    ORDER BY {_RANDOM}, {_IDS}) AS random_rank FROM plain),
chosen AS (
  SELECT {_IDS}, 2 * {_BUCKET} + (hard_rank > {_HARD})::INTEGER AS part,
    CASE WHEN hard_rank <= {_HARD} THEN hard_rank ELSE random_rank END AS place
  FROM balanced WHERE hard_rank <= {_HARD} OR random_rank <= {_QUOTA} - {_HARD}
  UNION ALL
  (SELECT {_IDS}, 100, row_number() OVER (ORDER BY ambiguity_score DESC,
     context_turn_count DESC, {_IDS}) AS place
   FROM v2d WHERE ambiguity_candidate ORDER BY place LIMIT 15)
  UNION ALL
  (SELECT {_IDS}, 101, row_number() OVER (ORDER BY len(flags) DESC, ambiguity_score DESC,
     {_IDS}) AS place
   FROM v2d WHERE escalation_candidate AND NOT ambiguity_candidate ORDER BY place LIMIT 15)),
filled AS (
  SELECT * FROM chosen UNION ALL
  SELECT {_IDS}, 102, row_number() OVER (ORDER BY context_turn_count + ambiguity_score
    + escalation_candidate::INTEGER DESC, {_IDS})
  FROM v2d WHERE customer_tweet_id NOT IN (SELECT customer_tweet_id FROM chosen)),
golden AS (
  SELECT 'GS-' || lpad(CAST(row_number() OVER (ORDER BY part, place) AS VARCHAR), 4, '0')
    AS golden_id, {_IDS}, part
  FROM (SELECT * FROM filled ORDER BY part, place LIMIT 200))"""
_G = q.with_(q.CONTEXTUAL, q.V2, _GOLDEN)


@query(
    "sp3_quota_sample_v2",
    _G + f"SELECT candidate_intent, {_IDS} FROM golden JOIN v2d USING ({_IDS}) WHERE part < 100",
)
def _sp3(spark, sf):
    distinct = cut_lineage(distinct_v2(spark, sf))
    ids = sampling.quota_sample_v2(distinct).where(F.col("part") < 2 * len(lx.V2_QUOTAS))
    return distinct.join(F.broadcast(ids), sampling.PAIR_IDS).select(  # at most 170 ids
        "candidate_intent", *sampling.PAIR_IDS
    )


@query(
    "sp4_hard_slices_v2",
    _G + f"SELECT {_IDS}, part = 100 AS ambiguous FROM golden WHERE part IN (100, 101)",
)
def _sp4(spark, sf):
    ids = sampling.quota_sample_v2(cut_lineage(distinct_v2(spark, sf)))
    last = 2 * len(lx.V2_QUOTAS)
    return ids.where(F.col("part").isin(last, last + 1)).select(
        *sampling.PAIR_IDS, (F.col("part") == last).alias("ambiguous")
    )


_REASON = (
    "CASE WHEN NOT ambiguity_candidate AND NOT escalation_candidate AND context_turn_count < 2 "
    "THEN 'balanced_intent' ELSE concat_ws(';', CASE WHEN ambiguity_candidate THEN 'ambiguous' END, "
    "CASE WHEN escalation_candidate THEN 'escalation' END, "
    "CASE WHEN context_turn_count >= 2 THEN 'context_heavy' END) END"
)


@query(
    "sp5_golden_sample_v2",
    _G + f"SELECT golden_id, {_IDS}, candidate_intent, {_REASON} AS sampling_reason "
    f"FROM golden JOIN v2d USING ({_IDS})",
)
def _sp5(spark, sf):
    golden = sampling.golden_sample_v2(cut_lineage(distinct_v2(spark, sf)))
    return golden.select("golden_id", *sampling.PAIR_IDS, "candidate_intent", "sampling_reason")


@query(
    "sp6_backup_pool_v2",
    _G
    + f"""SELECT 'BK-' || lpad(CAST(row_number() OVER (ORDER BY part, place) AS VARCHAR), 4, '0')
  AS backup_id, {_IDS}
FROM (
  SELECT {_IDS}, (hard_rank > 300)::INTEGER AS part,
    CASE WHEN hard_rank <= 300 THEN hard_rank ELSE row_number() OVER (PARTITION BY hard_rank <= 300
      ORDER BY {_RANDOM}, {_IDS}) END AS place
  FROM (SELECT *, row_number() OVER (ORDER BY ambiguity_score + escalation_candidate::INTEGER * 2
      + (context_turn_count >= 2)::INTEGER DESC, {_IDS}) AS hard_rank
    FROM v2d WHERE customer_tweet_id NOT IN (SELECT customer_tweet_id FROM golden))
  ORDER BY part, place LIMIT 600)""",
)
def _sp6(spark, sf):
    distinct = cut_lineage(distinct_v2(spark, sf))
    golden = cut_lineage(sampling.golden_sample_v2(distinct).select(*sampling.PAIR_IDS))
    return sampling.backup_pool_v2(distinct, golden).select("backup_id", *sampling.PAIR_IDS)


@query(
    "sp7_sample_mistakes",
    q.with_(q.CONTEXTUAL, q.V2, GOLD_PRED)
    + f"SELECT brand_tweet_id, gold, pred FROM labelled WHERE gold <> pred ORDER BY "
    f"{q.seeded(42, 'brand_tweet_id')} LIMIT 10",
)
def _sp7(spark, sf):
    wrong = evaluation.mistakes(gold_and_pred(spark, sf), "gold", "pred")
    return sampling.sample_n(wrong, 10, "brand_tweet_id").select("brand_tweet_id", "gold", "pred")


