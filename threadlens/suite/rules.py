"""Queries: phrase-rule labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions import rules as rl
from threadlens.functions import text as tx
from threadlens.operators import gating, labelling
from threadlens.suite import fixtures as fx
from threadlens.suite import sql as q
from threadlens.suite.base import query

_LOW = "low AS (SELECT *, lower(current_customer_message) AS t FROM contextual)"
_TERMS = lx.FINAL_UNRESOLVED


def _lowered(spark, sf):
    return fx.contextual(spark, sf).select(
        "brand_tweet_id", F.lower("current_customer_message").alias("t")
    )


@query(
    "rl1_any_phrase",
    q.with_(q.CONTEXTUAL, _LOW)
    + f"SELECT brand_tweet_id, {q.any_of('t', _TERMS)} AS hit FROM low",
)
def _rl1(spark, sf):
    return _lowered(spark, sf).select(
        "brand_tweet_id", rl.contains_any(F.col("t"), _TERMS).alias("hit")
    )


@query(
    "rl2_match_count",
    q.with_(q.CONTEXTUAL, _LOW)
    + f"SELECT brand_tweet_id, {q.count_of('t', _TERMS)}::INTEGER AS n, "
    f"{q.joined(q.hits('t', _TERMS), ', ')} AS matched FROM low",
)
def _rl2(spark, sf):
    t = F.col("t")
    return _lowered(spark, sf).select(
        "brand_tweet_id", rl.match_count(t, _TERMS).alias("n"),
        tx.join_labels(rl.matches(t, _TERMS)).alias("matched"),
    )


@query(
    "rl3_label_by_count",
    q.with_(q.CONTEXTUAL, _LOW, f"s AS (SELECT *, {q.scores('t', lx.V1_INTENTS)} AS s FROM low)")
    + f"SELECT brand_tweet_id, {q.best_label('s', list(lx.V1_INTENTS), 'other')} AS label FROM s",
)
def _rl3(spark, sf):
    return _lowered(spark, sf).select(
        "brand_tweet_id", rl.label_by_count(F.col("t"), lx.V1_INTENTS, "other").alias("label")
    )


_A = q.with_(q.CONTEXTUAL, q.ANALYSIS)
_V1 = q.with_(q.CONTEXTUAL, q.V1)
_V2 = q.with_(q.CONTEXTUAL, q.V2)


def _analysis(spark, sf, part):
    return labelling.label_analysis(fx.contextual(spark, sf), [part])


def _v1(spark, sf, part):
    return labelling.label_v1(fx.contextual(spark, sf), [part])


def _v2(spark, sf, part):
    return labelling.label_v2(fx.contextual(spark, sf), [part])


@query("rl4_intent_cascade", _A + "SELECT brand_tweet_id, candidate_intent FROM analysis")
def _rl4(spark, sf):
    return _analysis(spark, sf, "intent").select("brand_tweet_id", "candidate_intent")


@query("rl5_historical_action", _A + "SELECT brand_tweet_id, historical_action FROM analysis")
def _rl5(spark, sf):
    return _analysis(spark, sf, "action").select("brand_tweet_id", "historical_action")


@query(
    "rl6_escalation_signals",
    _A + f"SELECT brand_tweet_id, {q.joined('sig', ', ')} AS escalation_signals, "
    "len(sig) > 0 AS potential_escalation FROM analysis",
)
def _rl6(spark, sf):
    return _analysis(spark, sf, "signals").select(
        "brand_tweet_id", tx.join_labels("escalation_signals").alias("escalation_signals"),
        "potential_escalation",
    )


@query(
    "rl7_ambiguous_messages",
    _A + "SELECT brand_tweet_id, potentially_ambiguous FROM analysis",
)
def _rl7(spark, sf):
    return _analysis(spark, sf, "ambiguous").select("brand_tweet_id", "potentially_ambiguous")


@query("rl8_intent_v1", _V1 + "SELECT brand_tweet_id, candidate_intent FROM v1")
def _rl8(spark, sf):
    return _v1(spark, sf, "intent").select("brand_tweet_id", "candidate_intent")


@query("rl9_action_v1", _V1 + "SELECT brand_tweet_id, candidate_action FROM v1")
def _rl9(spark, sf):
    return _v1(spark, sf, "action").select("brand_tweet_id", "candidate_action")


@query(
    "rl10_signals_v1",
    _V1 + f"SELECT brand_tweet_id, {q.joined('sig', '|')} AS escalation_signals FROM v1",
)
def _rl10(spark, sf):
    return _v1(spark, sf, "signals").select("brand_tweet_id", "escalation_signals")


@query("rl11_ambiguity_v1", _V1 + "SELECT brand_tweet_id, ambiguity_score FROM v1")
def _rl11(spark, sf):
    return _v1(spark, sf, "ambiguity").select("brand_tweet_id", "ambiguity_score")


@query(
    "rl12_ranked_intents_v2",
    _V2
    + "SELECT brand_tweet_id, z[1] AS label, z[2]::INTEGER AS score, (row_number() OVER "
    "(PARTITION BY brand_tweet_id ORDER BY z[2] DESC, z[3]))::INTEGER AS rank FROM "
    f"(SELECT brand_tweet_id, unnest(list_zip({q.lits(list(lx.V2_INTENTS))}, s, "
    f"range({len(lx.V2_INTENTS)}))) AS z FROM v2)",
)
def _rl12(spark, sf):
    staged = rl.computed(
        fx.contextual(spark, sf),
        {
            "cur": tx.clean_sampling("current_customer_message"),
            "ctx": tx.clean_sampling("conversation_context"),
        },
    )
    ranked = labelling.ranked_intents_v2(F.col("cur"), F.col("ctx"))
    each = staged.select("brand_tweet_id", F.posexplode(ranked).alias("at", "r"))
    return each.select(
        "brand_tweet_id", "r.label", "r.score", (F.col("at") + 1).alias("rank")
    )


@query("rl13_intent_v2", _V2 + "SELECT brand_tweet_id, candidate_intent FROM v2")
def _rl13(spark, sf):
    return _v2(spark, sf, "intent").select("brand_tweet_id", "candidate_intent")


@query(
    "rl14_intent_details_v2",
    _V2 + "SELECT brand_tweet_id, candidate_intent, candidate_score, candidate_second_score, "
    "candidate_margin, candidate_matches FROM v2",
)
def _rl14(spark, sf):
    return _v2(spark, sf, "intent").select(
        "brand_tweet_id", "candidate_intent", "candidate_score", "candidate_second_score",
        "candidate_margin", "candidate_matches",
    )


@query(
    "rl15_action_v2",
    _V2 + "SELECT brand_tweet_id, candidate_action, candidate_action_matches FROM v2",
)
def _rl15(spark, sf):
    return _v2(spark, sf, "action").select(
        "brand_tweet_id", "candidate_action",
        tx.join_labels("candidate_action_matches", "; ").alias("candidate_action_matches"),
    )


@query(
    "rl16_flags_v2",
    _V2 + "SELECT brand_tweet_id, escalation_flags, escalation_candidate FROM v2",
)
def _rl16(spark, sf):
    return _v2(spark, sf, "flags").select(
        "brand_tweet_id", tx.join_labels("escalation_flags", ";").alias("escalation_flags"),
        "escalation_candidate",
    )


@query(
    "rl17_ambiguity_v2",
    _V2 + "SELECT brand_tweet_id, ambiguity_reasons, ambiguity_score, ambiguity_candidate FROM v2",
)
def _rl17(spark, sf):
    return _v2(spark, sf, "ambiguity").select(
        "brand_tweet_id", tx.join_labels("ambiguity_reasons", ";").alias("ambiguity_reasons"),
        "ambiguity_score", "ambiguity_candidate",
    )


@query(
    "rl18_silver_intent",
    q.with_(q.CONTEXTUAL)
    + "SELECT brand_tweet_id, "
    + q.cascade("lower(current_customer_message)", lx.SILVER_INTENTS, "unknown")
    + " AS silver_intent FROM contextual",
)
def _rl18(spark, sf):
    return fx.contextual(spark, sf).select(
        "brand_tweet_id",
        labelling.silver_intent("current_customer_message").alias("silver_intent"),
    )


_REASON = (
    "CASE WHEN NOT ambiguity_candidate AND NOT escalation_candidate AND context_turn_count < 2 "
    "THEN 'balanced_intent' ELSE concat_ws(';', CASE WHEN ambiguity_candidate THEN 'ambiguous' END, "
    "CASE WHEN escalation_candidate THEN 'escalation' END, "
    "CASE WHEN context_turn_count >= 2 THEN 'context_heavy' END) END"
)


@query(
    "rl19_sampling_reason",
    _V2 + f"SELECT brand_tweet_id, {_REASON} AS sampling_reason FROM v2",
)
def _rl19(spark, sf):
    df = labelling.label_v2(fx.contextual(spark, sf), ["flags", "ambiguity"])
    return df.select("brand_tweet_id", labelling.sampling_reason().alias("sampling_reason"))


@query(
    "rl20_response_action",
    q.with_(q.CONTEXTUAL)
    + "SELECT brand_tweet_id, "
    + q.cascade("lower(historical_brand_response)", lx.FINAL_ACTIONS, "information")
    + " AS action FROM contextual",
)
def _rl20(spark, sf):
    return fx.contextual(spark, sf).select(
        "brand_tweet_id", gating.choose_action("historical_brand_response").alias("action")
    )
