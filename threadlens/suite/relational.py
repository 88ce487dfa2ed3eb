"""Queries: joins, threads, history, aggregates and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions import text as tx
from threadlens.operators import (
    dedup, frequency, gating, goldset, history, labelling, pairing, profile, retrieval,
    sampling, threads,
)
from threadlens.plans import report
from threadlens.session import cut_lineage
from threadlens.suite import fixtures as fx
from threadlens.suite import sql as q
from threadlens.suite.base import query

_ISO = "yyyy-MM-dd HH:mm:ss"
_PAIR_SQL = (
    "SELECT customer_tweet_id, brand_tweet_id, customer_author_id, md5(customer_text) AS "
    f"customer_md5, md5(brand_response) AS brand_md5, {q.text_time('customer_created_at')} AS "
    f"customer_created_at, {q.text_time('brand_created_at')} AS brand_created_at, "
    "customer_response_tweet_id, brand_in_response_to FROM pairs"
)


def _pair_view(p):
    return p.select(
        "customer_tweet_id", "brand_tweet_id", "customer_author_id",
        F.md5("customer_text").alias("customer_md5"), F.md5("brand_response").alias("brand_md5"),
        F.date_format("customer_created_at", _ISO).alias("customer_created_at"),
        F.date_format("brand_created_at", _ISO).alias("brand_created_at"),
        "customer_response_tweet_id", "brand_in_response_to",
    )


# -- joins and threads --------------------------------------------------------


@query("jn1_reply_pairs", q.with_(q.TWEETS, q.PAIRS) + _PAIR_SQL)
def _jn1(spark, sf):
    return _pair_view(fx.pairs(spark, sf))


@query("jn1_reply_pairs_events", q.with_(q.EVENT_TWEETS, q.PAIRS) + _PAIR_SQL)
def _jn1e(spark, sf):
    return _pair_view(pairing.build_pairs(fx.event_tweets(spark, sf), fx.BRAND))


@query(
    "jn2_pair_audit",
    q.with_(q.EVENT_TWEETS)
    + f"SELECT count(*) FILTER (p.tweet_id IS NOT NULL AND p.author_id <> '{fx.BRAND}') AS matched, "
    "count(*) FILTER (p.tweet_id IS NULL) AS missing_parent, "
    f"count(*) FILTER (p.author_id = '{fx.BRAND}') AS brand_parent "
    "FROM tweets r LEFT JOIN tweets p ON r.in_response_to_tweet_id = p.tweet_id "
    f"WHERE r.author_id = '{fx.BRAND}' AND NOT r.inbound AND r.in_response_to_tweet_id IS NOT NULL",
)
def _jn2(spark, sf):
    return pairing.pair_audit(fx.event_tweets(spark, sf), fx.BRAND)


@query(
    "jn3_orphan_replies",
    q.with_(q.EVENT_TWEETS)
    + "SELECT tweet_id AS brand_tweet_id, in_response_to_tweet_id AS brand_in_response_to "
    f"FROM tweets r WHERE author_id = '{fx.BRAND}' AND NOT inbound AND "
    "in_response_to_tweet_id IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM tweets p WHERE p.tweet_id = r.in_response_to_tweet_id)",
)
def _jn3(spark, sf):
    return pairing.orphan_replies(fx.event_tweets(spark, sf), fx.BRAND)


_CONTEXT_SQL = (
    "SELECT customer_tweet_id, brand_tweet_id, customer_author_id, current_customer_message, "
    "historical_brand_response, conversation_context, context_turn_count, "
    f"{q.text_time('customer_created_at')} AS customer_created_at FROM chain"
)


def _context_view(c):
    return c.drop("brand_created_at").withColumn(
        "customer_created_at", F.date_format("customer_created_at", _ISO)
    )


@query("jn4_chain_context", q.with_(q.TWEETS, q.PAIRS, q.CHAIN) + _CONTEXT_SQL)
def _jn4(spark, sf):
    return _context_view(threads.chain_context(fx.tweets(spark, sf), fx.BRAND))


@query("jn4_chain_context_events", q.with_(q.EVENT_TWEETS, q.PAIRS, q.CHAIN) + _CONTEXT_SQL)
def _jn4e(spark, sf):
    return _context_view(threads.chain_context(fx.event_tweets(spark, sf), fx.BRAND))


@query(
    "jn5_render_context",
    q.with_(q.EVENT_TWEETS, q.PAIRS, q.CHAIN)
    + "SELECT customer_tweet_id, brand_tweet_id, "
    f"replace(conversation_context, '{fx.BRAND}: ', 'Agent: ') AS conversation_context, "
    "context_turn_count FROM chain",
)
def _jn5(spark, sf):
    turns = threads.chain_turns(fx.event_tweets(spark, sf), fx.BRAND)
    return threads.render_context(turns, "Agent").select(
        "customer_tweet_id", "brand_tweet_id", "conversation_context", "context_turn_count"
    )


# Pair-level walk as a recursive query.
THREADS_SQL = """hops AS (
  SELECT brand_tweet_id AS root, 0 AS n, brand_tweet_id AS at, customer_in_response_to AS ptr,
    CAST([] AS VARCHAR[]) AS seen
  FROM pairs
  UNION ALL
  SELECT h.root, h.n + 1, p.brand_tweet_id, p.customer_in_response_to,
    list_append(h.seen, p.brand_tweet_id)
  FROM hops h JOIN pairs p ON p.brand_tweet_id = h.ptr
  WHERE h.n < 3 AND NOT list_contains(h.seen, h.ptr)),
turns AS (
  SELECT h.root, h.n, p.* FROM hops h JOIN pairs p ON p.brand_tweet_id = h.at WHERE h.n > 0)"""


def _prev(n: int) -> str:
    cells = (
        (q.strip("customer_text"), "customer"), (q.strip("brand_response"), "brand"),
        ("customer_tweet_id", "customer_tweet_id"), ("brand_tweet_id", "brand_tweet_id"),
    )
    return ", ".join(
        f"coalesce((SELECT max({e}) FROM turns t WHERE t.root = p.brand_tweet_id AND t.n = {n}), '') "
        f"AS prev_{n}_{c}"
        for e, c in cells
    )


WIDE_SQL = (
    f"SELECT customer_tweet_id, brand_tweet_id, {q.strip('customer_text')} AS customer_text, "
    f"customer_in_response_to, {_prev(1)}, {_prev(2)}, {_prev(3)}, "
    "(SELECT count(*) FROM turns t WHERE t.root = p.brand_tweet_id)::INTEGER AS previous_turn_count "
    "FROM pairs p"
)


def _wide_view(p, t):
    wide = threads.thread_wide(threads.thread_context(p, t))
    return wide.drop(
        "customer_author_id", "brand_response", "customer_created_at", "brand_created_at",
        "customer_response_tweet_id", "brand_in_response_to",
    )


@query(
    "jn6_thread_turns",
    q.with_(q.EVENT_TWEETS, q.PAIRS, THREADS_SQL)
    + "SELECT root AS brand_tweet_id, n::INTEGER AS turn, brand_tweet_id AS turn_brand_tweet_id, "
    "customer_tweet_id AS turn_customer_tweet_id FROM turns",
)
def _jn6(spark, sf):
    t = fx.event_tweets(spark, sf)
    walked = threads.thread_context(pairing.build_pairs(t, fx.BRAND), t)
    turns = walked.select("brand_tweet_id", F.posexplode("turns").alias("i", "t"))
    return turns.select(
        "brand_tweet_id", (F.col("i") + 1).alias("turn"),
        F.col("t.brand_tweet_id").alias("turn_brand_tweet_id"),
        F.col("t.customer_tweet_id").alias("turn_customer_tweet_id"),
    )


@query("jn7_thread_wide", q.with_(q.TWEETS, q.PAIRS, THREADS_SQL) + WIDE_SQL)
def _jn7(spark, sf):
    t = fx.tweets(spark, sf)
    return _wide_view(fx.pairs(spark, sf), t)


def _history_sql(label: str) -> str:
    turn = f"'Customer: ' || customer_text || chr(10) || '{label}: ' || brand_response"
    order = "customer_created_at NULLS LAST, brand_created_at NULLS LAST, brand_tweet_id"
    return f"""h0 AS (
  SELECT *, list({turn}) OVER (PARTITION BY customer_author_id ORDER BY {order}
    ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before
  FROM pairs),
h1 AS (
  SELECT *, row_number() OVER (PARTITION BY customer_tweet_id
    ORDER BY brand_created_at DESC NULLS FIRST, brand_tweet_id DESC) AS last FROM h0),
history AS (
  SELECT customer_tweet_id, CASE WHEN coalesce(len(before), 0) = 0 THEN customer_text
    ELSE array_to_string(before, chr(10)) || chr(10) || 'Customer: ' || customer_text END
    AS context_text
  FROM h1 WHERE last = 1)"""


@query(
    "wn1_customer_history",
    q.with_(q.TWEETS, q.PAIRS, _history_sql(fx.BRAND)) + "SELECT * FROM history",
)
def _wn1(spark, sf):
    return history.customer_history(fx.pairs(spark, sf), brand_label=fx.BRAND)


@query(
    "wn2_last_context_wins",
    q.with_(q.EVENT_TWEETS, q.PAIRS, _history_sql(fx.BRAND)) + "SELECT * FROM history",
)
def _wn2(spark, sf):
    # Several replies to one event, and customers of many rows cut into slices.
    p = pairing.build_pairs(fx.event_tweets(spark, sf), fx.BRAND)
    return history.customer_history(p, brand_label=fx.BRAND, hot_rows=20)


SPLIT_SQL = (
    f"silver AS (SELECT *, {q.SILVER} AS silver_intent FROM pairs), "
    "split AS (SELECT *, CASE WHEN CAST('0x' || substr("
    + q.seeded(42, "customer_author_id")
    + ", 1, 8) AS BIGINT) < 644245094 THEN 'validation' ELSE 'train' END AS split "
    "FROM silver WHERE silver_intent <> 'unknown')"
)


def silver_split(spark, sf):
    return sampling.group_split(
        labelling.usable_silver(fx.pairs(spark, sf)), "customer_author_id"
    )


@query(
    "jn8_attach_context",
    q.with_(q.TWEETS, q.PAIRS, SPLIT_SQL, _history_sql(fx.BRAND))
    + "SELECT brand_tweet_id, s.customer_tweet_id, split, "
    "coalesce(context_text, customer_text) AS context_text "
    "FROM split s LEFT JOIN history h ON s.customer_tweet_id = h.customer_tweet_id",
)
def _jn8(spark, sf):
    context = history.customer_history(fx.pairs(spark, sf), brand_label=fx.BRAND)
    return history.attach_context(silver_split(spark, sf), context).select(
        "brand_tweet_id", "customer_tweet_id", "split", "context_text"
    )


@query(
    "jn9_retrieval_corpus",
    q.with_(q.TWEETS, q.PAIRS, SPLIT_SQL)
    + "SELECT brand_tweet_id, customer_tweet_id FROM pairs WHERE customer_tweet_id IN "
    "(SELECT customer_tweet_id FROM split WHERE split = 'train')",
)
def _jn9(spark, sf):
    train = silver_split(spark, sf).where("split = 'train'")
    return retrieval.retrieval_corpus(fx.pairs(spark, sf), train).select(
        "brand_tweet_id", "customer_tweet_id"
    )


@query(
    "jn10_case_intents",
    q.with_(q.TWEETS, q.PAIRS, SPLIT_SQL)
    + "SELECT p.brand_tweet_id, t.intent FROM pairs p LEFT JOIN (SELECT customer_tweet_id, "
    "arg_max(silver_intent, brand_tweet_id) AS intent FROM split WHERE split = 'train' "
    "GROUP BY customer_tweet_id) t USING (customer_tweet_id)",
)
def _jn10(spark, sf):
    train = silver_split(spark, sf).where("split = 'train'")
    return retrieval.with_silver_intent(
        fx.pairs(spark, sf), train, ["customer_created_at", "brand_tweet_id"]
    ).select("brand_tweet_id", "intent")


def gold_sheet(spark, sf):
    """Pairs as a labelling sheet, and labels for every silver-labelled row."""
    p = fx.pairs(spark, sf).withColumn("golden_id", F.concat(F.lit("GS-"), "brand_tweet_id"))
    labels = labelling.usable_silver(p).select(
        "golden_id", F.col("silver_intent").alias("intent"),
        gating.choose_action("brand_response").alias("action"),
        F.when(F.contains(F.lower("customer_text"), F.lit("still")), "ESCALATE")
        .otherwise("AUTO-HANDLE").alias("handling"),
        F.when(F.length("brand_response") > 80, "YES").otherwise("NO").alias("evidence"),
    )
    return goldset.labeling_template(p), labels


_REASON = (
    "CASE silver_intent "
    + " ".join(f"WHEN {q.lit(k)} THEN {q.lit(v)}" for k, v in lx.GOLD_REASONS.items())
    + " END || CASE WHEN contains(lower(customer_text), 'still') THEN "
    + f"{q.lit(lx.GOLD_REASON_ESCALATE)} ELSE {q.lit(lx.GOLD_REASON_AUTO)} END"
)
ACTION_SQL = q.cascade("lower(brand_response)", lx.FINAL_ACTIONS, "information")


@query(
    "jn11_apply_gold_labels",
    q.with_(q.TWEETS, q.PAIRS)
    + "SELECT 'GS-' || brand_tweet_id AS golden_id, CASE WHEN known THEN silver_intent ELSE '' END "
    f"AS gold_intent, CASE WHEN known THEN {ACTION_SQL} ELSE '' END AS gold_action, "
    "CASE WHEN NOT known THEN '' WHEN contains(lower(customer_text), 'still') THEN 'ESCALATE' "
    f"ELSE 'AUTO-HANDLE' END AS gold_handling, CASE WHEN known THEN {_REASON} ELSE '' END "
    "AS gold_reason, CASE WHEN NOT known THEN '' WHEN length(brand_response) > 80 THEN 'YES' "
    "ELSE 'NO' END AS gold_evidence_sufficient FROM "
    f"(SELECT *, silver_intent <> 'unknown' AS known FROM "
    f"(SELECT *, {q.SILVER} AS silver_intent FROM pairs))",
)
def _jn11(spark, sf):
    sheet, labels = gold_sheet(spark, sf)
    return goldset.apply_gold(sheet, labels).select("golden_id", *lx.GOLD_COLUMNS)


@query(
    "jn12_exclude_chosen",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN "
    "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def _jn12(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    chosen = fx.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("o_custkey")
    )
    return dedup.exclude(orders, chosen, "o_custkey").select("o_orderkey", "o_custkey")


# -- account activity ---------------------------------------------------------

_ACTIVITY = (
    "activity AS (SELECT CAST(user_id AS VARCHAR) AS brand_author_id, count(*) AS total_tweets, "
    "count(*) FILTER (event_type IN ('view', 'click')) AS inbound_tweets, "
    "count(*) FILTER (event_type NOT IN ('view', 'click')) AS outbound_tweets "
    "FROM events GROUP BY user_id)"
)


def _account_events(spark, sf):
    return fx.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("author_id"),
        F.col("event_type").isin("view", "click").alias("inbound"),
    )


@query("ag1_account_counts", q.with_(_ACTIVITY) + "SELECT * FROM activity")
def _ag1(spark, sf):
    return profile.account_counts(_account_events(spark, sf))


@query(
    "ag2_active_accounts",
    q.with_(_ACTIVITY)
    + "SELECT *, round(outbound_tweets / total_tweets, 3) AS outbound_ratio FROM activity "
    "WHERE outbound_tweets >= 40",
)
def _ag2(spark, sf):
    return profile.brand_activity(_account_events(spark, sf), 40)


@query(
    "ag3_brand_summary",
    q.with_(q.EVENT_TWEETS)
    + "SELECT count(*) AS total_tweets, count(*) FILTER (NOT inbound) AS replies, "
    f"count(*) FILTER (inbound) AS inbound_tweets FROM tweets WHERE author_id = '{fx.BRAND}'",
)
def _ag3(spark, sf):
    return profile.brand_summary(fx.event_tweets(spark, sf), fx.BRAND)


@query(
    "sl1_top_accounts",
    q.with_(_ACTIVITY)
    + "SELECT *, round(outbound_tweets / total_tweets, 3) AS outbound_ratio FROM activity "
    "WHERE outbound_tweets >= 1 ORDER BY outbound_tweets DESC, total_tweets DESC, brand_author_id "
    "LIMIT 50",
)
def _sl1(spark, sf):
    return profile.top_accounts(profile.brand_activity(_account_events(spark, sf), 1))


@query(
    "fn16_sequential_ids",
    q.with_(_ACTIVITY)
    + "SELECT 'AC-' || lpad(CAST(row_number() OVER (ORDER BY outbound_tweets DESC, "
    "total_tweets DESC, brand_author_id) AS VARCHAR), 4, '0') AS account_no, brand_author_id "
    "FROM activity ORDER BY account_no LIMIT 50",
)
def _fn16(spark, sf):
    top = profile.top_accounts(profile.brand_activity(_account_events(spark, sf), 1))
    order = [F.desc("outbound_tweets"), F.desc("total_tweets"), "brand_author_id"]
    return goldset.with_seq_id(top, "account_no", "AC", order).select(
        "account_no", "brand_author_id"
    )


# -- aggregates ---------------------------------------------------------------


def analysis(spark, sf):
    return labelling.label_analysis(fx.contextual(spark, sf))


_A = q.with_(q.CONTEXTUAL, q.ANALYSIS)


@query(
    "ag4_intent_frequency",
    _A
    + "SELECT candidate_intent, count(*) AS count, round(count(*) / (SELECT count(*) FROM analysis) "
    "* 100e0, 2) AS percentage FROM analysis GROUP BY candidate_intent",
)
def _ag4(spark, sf):
    return frequency.frequency(analysis(spark, sf), "candidate_intent")


@query(
    "ag4_priority_frequency",
    "SELECT o_orderpriority, count(*) AS count, round(count(*) / (SELECT count(*) FROM orders) "
    "* 100e0, 2) AS percentage FROM orders GROUP BY o_orderpriority",
)
def _ag4b(spark, sf):
    return frequency.frequency(fx.table(spark, sf, "orders"), "o_orderpriority")


@query(
    "ag5_intent_action_share",
    _A
    + "SELECT candidate_intent, "
    + ", ".join(
        f"round(count(*) FILTER (historical_action = {q.lit(a)}) / count(*) * 100e0, 2) AS {a}"
        for a in [*lx.ANALYSIS_ACTIONS, "other"]
    )
    + " FROM analysis GROUP BY candidate_intent",
)
def _ag5(spark, sf):
    return frequency.crosstab_pct(
        analysis(spark, sf), "candidate_intent", "historical_action",
        [*lx.ANALYSIS_ACTIONS, "other"],
    )


@query(
    "ag5_intent_action_long",
    _A
    + "SELECT candidate_intent, historical_action, count(*) AS count, round(count(*) / "
    "sum(count(*)) OVER (PARTITION BY candidate_intent) * 100e0, 2) AS percentage "
    "FROM analysis GROUP BY candidate_intent, historical_action",
)
def _ag5b(spark, sf):
    return frequency.crosstab_long(analysis(spark, sf), "candidate_intent", "historical_action")


@query(
    "ag6_signal_counts",
    _A + "SELECT signal, count(*) AS count FROM (SELECT unnest(sig) AS signal FROM analysis) "
    "GROUP BY signal",
)
def _ag6(spark, sf):
    return frequency.label_counts(analysis(spark, sf), "escalation_signals")


@query(
    "ag7_intent_by_turns",
    _A + "SELECT context_turn_count, candidate_intent, count(*) AS count FROM analysis "
    "GROUP BY context_turn_count, candidate_intent",
)
def _ag7(spark, sf):
    return frequency.group_counts(analysis(spark, sf), "context_turn_count", "candidate_intent")


@query(
    "ag8_distinct_customers",
    "SELECT count(DISTINCT o_custkey) AS distinct_count FROM orders",
)
def _ag8(spark, sf):
    return frequency.distinct_count(fx.table(spark, sf, "orders"), "o_custkey")


@query(
    "ag9_turn_stats",
    q.with_(q.EVENT_TWEETS, q.PAIRS, q.CHAIN)
    + "SELECT context_turn_count AS turns, count(*) AS count, "
    "round((SELECT avg(context_turn_count) FROM chain), 6) AS mean_turns "
    "FROM chain GROUP BY context_turn_count",
)
def _ag9(spark, sf):
    return threads.turn_stats(threads.chain_context(fx.event_tweets(spark, sf), fx.BRAND))


@query(
    "ag10_flag_shares",
    _A
    + "SELECT 'escalation' AS flag, count(*) FILTER (len(sig) > 0) AS flagged, "
    "round(avg((len(sig) > 0)::DOUBLE) * 100e0, 2) AS percentage FROM analysis UNION ALL "
    "SELECT 'ambiguous', count(*) FILTER (potentially_ambiguous), "
    "round(avg(potentially_ambiguous::DOUBLE) * 100e0, 2) FROM analysis",
)
def _ag10(spark, sf):
    # Labelled once: two small columns of it are stored for both shares.
    a = cut_lineage(analysis(spark, sf).select("potential_escalation", "potentially_ambiguous"))
    return dedup.concat_parts(
        *[
            frequency.flag_share(a, col).select(F.lit(name).alias("flag"), "flagged", "percentage")
            for name, col in (
                ("escalation", "potential_escalation"), ("ambiguous", "potentially_ambiguous")
            )
        ]
    )


@query(
    "ag11_context_coverage",
    q.with_(q.TWEETS, q.PAIRS, SPLIT_SQL, _history_sql(fx.BRAND))
    + "SELECT split, count(*) FILTER (coalesce(context_text, customer_text) <> customer_text) "
    "AS with_context, count(*) AS total "
    "FROM split s LEFT JOIN history h ON s.customer_tweet_id = h.customer_tweet_id GROUP BY split",
)
def _ag11(spark, sf):
    context = history.customer_history(fx.pairs(spark, sf), brand_label=fx.BRAND)
    return history.context_coverage(history.attach_context(silver_split(spark, sf), context))


@query(
    "ag12_confidence_stats",
    "SELECT round(avg(value), 6) AS mean, round(median(value), 6) AS median, "
    "round(min(value), 6) AS min, round(max(value), 6) AS max FROM events",
)
def _ag12(spark, sf):
    return frequency.confidence_stats(fx.table(spark, sf, "events"), "value")


@query(
    "ag13_missing_labels",
    "SELECT 'quality' AS label_column, count(*) FILTER (quality IS NULL) AS missing FROM "
    "documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', "
    "count(*) FILTER (toxic IS NULL) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL "
    "SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents",
)
def _ag13(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "lang")
    joined = d.join(fx.table(spark, sf, "labels"), "doc_id", "left")
    return frequency.missing_labels(joined, ["quality", "toxic", "lang"])


# -- windows, top-k and set checks --------------------------------------------


@query(
    "wn3_examples_per_label",
    _A
    + "SELECT candidate_intent, customer_tweet_id, brand_tweet_id, left(current_customer_message, "
    "300) AS customer_preview, left(historical_brand_response, 300) AS response_preview, "
    "example_rank::INTEGER AS example_rank FROM (SELECT *, row_number() OVER (PARTITION BY "
    "candidate_intent ORDER BY customer_created_at, customer_tweet_id, brand_tweet_id) AS "
    "example_rank FROM analysis) WHERE example_rank <= 10",
)
def _wn3(spark, sf):
    shown = analysis(spark, sf).select(  # whole texts need not be ranked
        "candidate_intent", *sampling.PAIR_IDS, "customer_created_at",
        tx.preview("current_customer_message").alias("customer_preview"),
        tx.preview("historical_brand_response").alias("response_preview"),
    )
    return sampling.examples_per_label(shown).drop("customer_created_at")


@query(
    "sl2_flagged_examples",
    _A
    + "(SELECT 'escalation' AS kind, candidate_intent, brand_tweet_id, "
    f"{q.joined('sig', ', ')} AS escalation_signals FROM analysis WHERE len(sig) > 0 "
    "ORDER BY customer_tweet_id, brand_tweet_id LIMIT 500) UNION ALL "
    f"(SELECT 'ambiguous', candidate_intent, brand_tweet_id, {q.joined('sig', ', ')} "
    "FROM analysis WHERE potentially_ambiguous "
    "ORDER BY customer_tweet_id, brand_tweet_id LIMIT 500)",
)
def _sl2(spark, sf):
    a = cut_lineage(
        analysis(spark, sf).select(
            *sampling.PAIR_IDS, "candidate_intent", "escalation_signals", "potential_escalation",
            "potentially_ambiguous",
        )
    )
    return dedup.concat_parts(
        *[
            sampling.capped_examples(a, flag).select(
                F.lit(kind).alias("kind"), "candidate_intent", "brand_tweet_id",
                tx.join_labels("escalation_signals").alias("escalation_signals"),
            )
            for kind, flag in (
                ("escalation", "potential_escalation"), ("ambiguous", "potentially_ambiguous")
            )
        ]
    )


@query(
    "st4_group_overlap",
    "SELECT count(*) AS overlapping FROM (SELECT DISTINCT o_custkey FROM orders WHERE "
    "o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')",
)
def _st4(spark, sf):
    o = fx.table(spark, sf, "orders")
    return dedup.group_overlap(
        o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey"
    )


@query(
    "ev7_analysis_report",
    _A
    + """, n AS (SELECT count(*) AS n FROM analysis)
SELECT 'dataset' AS section, 'rows' AS key, CAST(count(*) AS DOUBLE) AS value FROM analysis
UNION ALL SELECT 'dataset', 'customers', count(DISTINCT customer_author_id) FROM analysis
UNION ALL SELECT 'escalation', 'count', count(*) FILTER (len(sig) > 0) FROM analysis
UNION ALL SELECT 'escalation', 'percentage',
  round(count(*) FILTER (len(sig) > 0) / count(*) * 100e0, 2) FROM analysis
UNION ALL SELECT 'ambiguous', 'count', count(*) FILTER (potentially_ambiguous) FROM analysis
UNION ALL SELECT 'ambiguous', 'percentage',
  round(count(*) FILTER (potentially_ambiguous) / count(*) * 100e0, 2) FROM analysis
UNION ALL SELECT 'intent_count', candidate_intent, count(*) FROM analysis GROUP BY ALL
UNION ALL SELECT 'intent_percentage', candidate_intent,
  round(count(*) / (SELECT n FROM n) * 100e0, 2) FROM analysis GROUP BY ALL
UNION ALL SELECT 'action_count', historical_action, count(*) FROM analysis GROUP BY ALL
UNION ALL SELECT 'action_percentage', historical_action,
  round(count(*) / (SELECT n FROM n) * 100e0, 2) FROM analysis GROUP BY ALL
UNION ALL SELECT 'intent_action_percentage', k, p FROM (
  SELECT candidate_intent || ' / ' || historical_action AS k, round(count(*) / sum(count(*))
    OVER (PARTITION BY candidate_intent) * 100e0, 2) AS p
  FROM analysis GROUP BY candidate_intent, historical_action)
UNION ALL SELECT 'signal_count', s, count(*) FROM
  (SELECT unnest(sig) AS s FROM analysis) GROUP BY s""",
)
def _ev7(spark, sf):
    return report.analysis_report(analysis(spark, sf))
