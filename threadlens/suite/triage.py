"""Queries: retrieval, gates, replies, triage and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions import text as tx
from threadlens.operators import features, gating, labelling, models, retrieval, threads
from threadlens.plans import report, triage
from threadlens.session import cut_lineage, run_dir
from threadlens.streaming.triage_stream import read_sink, triage_stream
from threadlens.suite import fixtures as fx
from threadlens.suite import sql as q
from threadlens.suite.base import query
from threadlens.suite.features import class_means_sql, grams_sql, tfidf_sql, weights_sql
from threadlens.suite.relational import SPLIT_SQL, THREADS_SQL, WIDE_SQL, silver_split

# -- retrieval ----------------------------------------------------------------

_TERMS = features.FINAL


def _documents_and_queries(spark, sf):
    at = F.col("doc_id") * 31
    cases = fx.documents(spark, sf).select(
        F.col("doc_id").alias("case_id"), "text",
        labelling.silver_intent(
            F.concat("text", F.lit(" "), fx.phrase(fx.USER_PHRASES, at))
        ).alias("intent"),
    )
    asked = fx.table(spark, sf, "benchmark").select(
        "item_id", "text", labelling.silver_intent("text").alias("predicted_intent")
    )
    return cases, asked


def _retrieved(spark, sf, k):
    cases, asked = _documents_and_queries(spark, sf)
    fitted, weights = features.fit_transform(cases, "case_id", "text", _TERMS)
    return retrieval.retrieve(
        cut_lineage(fitted.transform(asked, "item_id", "text")), cut_lineage(weights),
        k, "item_id", "case_id", ["intent"], queries=asked, cases=cases,
    )


_DECORATED = f"text || ' ' || {q.lits(fx.USER_PHRASES)}[1 + (doc_id * 31) % {len(fx.USER_PHRASES)}]"
_FOUND = q.with_(
    "cases AS (SELECT doc_id AS case_id, text, "
    + q.cascade(f"lower({_DECORATED})", lx.SILVER_INTENTS, "unknown")
    + " AS intent FROM documents)",
    tfidf_sql("cases", "case_id", "text", _TERMS, "g"),
    grams_sql("benchmark", "item_id", "text", _TERMS, "b"),
    weights_sql("g", "b_tf", "item_id", "b_w"),
    "scored AS (SELECT b.item_id, g.case_id, round(sum(b.weight * g.weight), 6) AS score "
    "FROM b_w b JOIN g_w g USING (term) GROUP BY ALL)",
    "found AS (SELECT item_id, case_id, intent, score, row_number() OVER "
    "(PARTITION BY item_id ORDER BY score DESC, case_id) AS rank FROM ("
    "SELECT b.item_id, c.case_id, c.intent, coalesce(s.score, 0e0) AS score "
    "FROM (SELECT DISTINCT item_id FROM benchmark) b CROSS JOIN cases c "
    "LEFT JOIN scored s ON s.item_id = b.item_id AND s.case_id = c.case_id))",
)


@query(
    "rt1_similar_cases",
    _FOUND + "SELECT item_id, case_id, intent, score, rank::INTEGER AS rank FROM found WHERE rank <= 3",
)
def _rt1(spark, sf):
    return _retrieved(spark, sf, 3)


@query(
    "rt2_prefer_same_intent",
    _FOUND
    + ", asked AS (SELECT item_id, "
    + q.cascade("lower(text)", lx.SILVER_INTENTS, "unknown")
    + " AS predicted_intent FROM benchmark) "
    "SELECT item_id, predicted_intent, case_id, intent, score FROM (SELECT *, row_number() OVER "
    "(PARTITION BY item_id ORDER BY (intent = predicted_intent) DESC, score DESC, case_id) AS pick "
    "FROM found JOIN asked USING (item_id) WHERE rank <= 30) WHERE pick = 1",
)
def _rt2(spark, sf):
    _, asked = _documents_and_queries(spark, sf)
    found = _retrieved(spark, sf, lx.FINAL_CANDIDATES)
    joined = found.join(asked.select("item_id", "predicted_intent"), "item_id")
    return retrieval.prefer_same_intent(joined, "item_id", "case_id").select(
        "item_id", "predicted_intent", "case_id", "intent", "score"
    )


_PREV = "concat_ws(chr(10), " + ", ".join(
    f"CASE WHEN prev_{i}_{f} <> '' THEN '{label}: ' || prev_{i}_{f} END"
    for i in (1, 2, 3)
    for f, label in (("customer", "Customer"), ("brand", "Brand"))
) + ")"


@query(
    "rt3_retrieval_text",
    q.with_(q.TWEETS, q.PAIRS, THREADS_SQL, f"wide AS ({WIDE_SQL})")
    + f"SELECT brand_tweet_id, {q.clean_basic('customer_text')} || ' ' || {q.clean_basic(_PREV)} "
    "AS retrieval_text FROM wide",
)
def _rt3(spark, sf):
    wide = threads.thread_wide(
        threads.thread_context(fx.pairs(spark, sf), fx.tweets(spark, sf))
    )
    text = retrieval.retrieval_text(F.col("customer_text"), threads.previous_turns_text())
    return wide.select("brand_tweet_id", text.alias("retrieval_text"))


@query(
    "rt4_evidence_flags",
    _FOUND
    + "SELECT item_id, case_id, CASE WHEN score >= 0.25 THEN 'YES' ELSE 'NO' END AS final_evidence, "
    "CASE WHEN score >= 0.20 THEN 'YES' ELSE 'NO' END AS demo_evidence FROM found WHERE rank = 1",
)
def _rt4(spark, sf):
    return _retrieved(spark, sf, 1).select(
        "item_id", "case_id", retrieval.evidence_flag("score").alias("final_evidence"),
        retrieval.evidence_flag("score", lx.DEMO_MIN_SIMILARITY).alias("demo_evidence"),
    )


# -- gates and replies --------------------------------------------------------
# Confidence and similarity derive from the message length, in hundredths, so that
# every branch and the exact thresholds occur.


def _gate_rows(spark, sf):
    n = F.length("current_customer_message")
    return fx.contextual(spark, sf).select(
        "brand_tweet_id", F.col("current_customer_message").alias("message"),
        F.col("historical_brand_response").alias("response"),
        labelling.silver_intent("current_customer_message").alias("intent"),
        ((n * 7) % 101 / F.lit(100e0)).alias("confidence"),
        (n % 61 / F.lit(100e0)).alias("similarity"),
    )


_GATE = q.with_(
    q.CONTEXTUAL,
    "rows AS MATERIALIZED (SELECT brand_tweet_id, current_customer_message AS message, "
    "historical_brand_response AS response, lower(current_customer_message) AS low, "
    + q.cascade("lower(current_customer_message)", lx.SILVER_INTENTS, "unknown")
    + " AS intent, ((length(current_customer_message) * 7) % 101) / 100e0 AS confidence, "
    "(length(current_customer_message) % 61) / 100e0 AS similarity FROM contextual)",
)
_RISK = f"({q.hits('low', lx.DEMO_RISK)})[1]"
_OPEN = f"({q.hits('low', lx.DEMO_UNRESOLVED)})[1]"


@query(
    "gt1_demo_gate",
    _GATE
    + f"""SELECT brand_tweet_id,
  CASE WHEN {_RISK} IS NOT NULL OR confidence < 0.58 OR similarity < 0.2 OR {_OPEN} IS NOT NULL
    THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS action,
  CASE WHEN {_RISK} IS NOT NULL THEN 'High-risk signal detected: ''' || {_RISK} || '''.'
    WHEN confidence < 0.58 THEN printf('Low intent confidence (%.2f).', confidence)
    WHEN similarity < 0.2 THEN {q.lit(lx.DEMO_REASON_WEAK)}
    WHEN {_OPEN} IS NOT NULL THEN 'Possible repeated/unresolved contact: ''' || {_OPEN} || '''.'
    ELSE {q.lit(lx.DEMO_REASON_AUTO)} END AS reason
FROM rows""",
)
def _gt1(spark, sf):
    gate = gating.gate_demo(F.col("message"), F.col("confidence"), F.col("similarity"))
    return _gate_rows(spark, sf).select("brand_tweet_id", gate.alias("g")).select(
        "brand_tweet_id", "g.*"
    )


_UNRESOLVED = q.any_of("low", lx.FINAL_UNRESOLVED)
_FINAL_CHECKS = [
    (q.any_of("low", lx.FINAL_STRONG), "security"),
    (f"intent = 'account_access' AND {_UNRESOLVED}", "account"),
    (f"intent IN ('delivery', 'order_status_tracking') AND {_UNRESOLVED}", "order"),
    (f"intent IN ('payment_billing', 'return_refund_replacement') AND {_UNRESOLVED}", "money"),
    ("intent = 'customer_service_complaint'", "complaint"),
    ("similarity < 0.25", "evidence"),
]
_FINAL_REASON = (
    "CASE "
    + " ".join(f"WHEN {c} THEN {q.lit(lx.FINAL_REASONS[n])}" for c, n in _FINAL_CHECKS)
    + f" ELSE {q.lit(lx.FINAL_REASONS['auto'])} END"
)
_FINAL = f"gated AS (SELECT *, {_FINAL_REASON} AS reason FROM rows)"
_HANDLING = (
    f"CASE WHEN reason = {q.lit(lx.FINAL_REASONS['auto'])} THEN 'AUTO-HANDLE' ELSE 'ESCALATE' END"
)


@query(
    "gt2_final_gate",
    _GATE + f", {_FINAL} SELECT brand_tweet_id, {_HANDLING} AS handling, reason FROM gated",
)
def _gt2(spark, sf):
    gate = gating.gate_final(F.col("message"), F.col("intent"), F.col("similarity"))
    return _gate_rows(spark, sf).select("brand_tweet_id", gate.alias("g")).select(
        "brand_tweet_id", "g.*"
    )


@query(
    "rp1_demo_reply",
    _GATE
    + f"SELECT brand_tweet_id, CASE WHEN similarity < 0.2 THEN {q.lit(lx.DEMO_REPLY_CLARIFY)} "
    f"WHEN intent <> 'delivery' THEN {q.lit(lx.DEMO_REPLY_GENERIC)} ELSE response END AS reply "
    "FROM rows",
)
def _rp1(spark, sf):
    reply = gating.reply_demo(
        F.lit("delivery"), F.col("similarity"), F.col("intent"), F.col("response")
    )
    return _gate_rows(spark, sf).select("brand_tweet_id", reply.alias("reply"))


_DEFAULT = lx.FINAL_REPLY_DEFAULT.format(brand="support", company="brand")


@query(
    "rp2_final_reply",
    _GATE
    + f", {_FINAL} SELECT brand_tweet_id, CASE intent "
    + " ".join(f"WHEN {q.lit(k)} THEN {q.lit(v)}" for k, v in lx.FINAL_REPLIES.items())
    + f" ELSE {q.lit(_DEFAULT)} END || CASE WHEN regexp_matches(response, {q.lit(tx.URL)}) THEN "
    f"{q.lit(lx.FINAL_REPLY_URL)} || regexp_extract(response, {q.lit(tx.URL)}) ELSE '' END || "
    f"CASE WHEN {_HANDLING} = 'ESCALATE' THEN {q.lit(lx.FINAL_REPLY_ROUTED)} ELSE '' END AS reply "
    "FROM gated",
)
def _rp2(spark, sf):
    rows = _gate_rows(spark, sf).withColumn(
        "g", gating.gate_final(F.col("message"), F.col("intent"), F.col("similarity"))
    )
    reply = gating.reply_final(
        F.col("intent"), F.col("response"), F.col("g.handling") == "ESCALATE"
    )
    return rows.select("brand_tweet_id", reply.alias("reply"))


# -- triage -------------------------------------------------------------------


def _contexts(spark, sf):
    """(context_id, context): the turns before a customer message, where it has a reply."""
    wide = threads.thread_wide(threads.thread_context(fx.pairs(spark, sf), fx.tweets(spark, sf)))
    return wide.groupBy(F.col("customer_tweet_id").alias("context_id")).agg(
        F.min(threads.previous_turns_text(brand_label=fx.BRAND)).alias("context")
    )


def _messages(df, contexts):
    """Inbound messages with the turns before them, as they would arrive."""
    rows = df.where(F.col("inbound"))
    return rows.join(contexts, F.col("tweet_id") == F.col("context_id"), "left").select(
        F.col("tweet_id").alias("message_id"), F.col("text").alias("message"),
        F.coalesce("context", F.lit("")).alias("context"), "created_at",
    )


def demo_model(spark, sf, fit=triage.fit_demo_intent):
    cases = labelling.usable_silver(fx.pairs(spark, sf)).select(
        F.col("brand_tweet_id").alias("id"), F.col("customer_text").alias("customer"),
        F.col("silver_intent").alias("intent"), F.col("brand_response").alias("brand_reply"),
    )
    return triage.fit_demo(cases, fit)


def final_model(spark, sf, fit=models.fit_intent):
    pairs = cut_lineage(fx.pairs(spark, sf))
    wide = threads.thread_wide(threads.thread_context(pairs, fx.tweets(spark, sf)))
    train = cut_lineage(silver_split(spark, sf).where("split = 'train'"))
    corpus = triage.final_corpus(wide, train, brand_label=fx.BRAND)
    return triage.fit_final(train, corpus, fit=fit)


@query("tr1_triage_demo")
def _tr1(spark, sf):
    out = triage.triage_demo(
        _messages(fx.tweets(spark, sf), _contexts(spark, sf)), demo_model(spark, sf)
    )
    return out.withColumn("evidence", F.to_json("evidence"))


@query("tr2_triage_final")
def _tr2(spark, sf):
    messages = cut_lineage(_messages(fx.tweets(spark, sf), _contexts(spark, sf)))
    return triage.triage_final(messages, final_model(spark, sf))


def _conversation_stream(spark, sf):
    """The conversations as a stream, whether the table is a file or a folder of files: a
    stream takes a pattern for either."""
    schema = fx.table(spark, sf, "conversations").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/conversations.parque[t]")


def _streamed(spark, sf, work):
    """``work`` on the conversations read as a stream of messages."""
    stream = _conversation_stream(spark, sf)
    sink = run_dir(spark, "triage")
    job = triage_stream(
        _messages(fx.conversation_tweets(stream), cut_lineage(_contexts(spark, sf))),
        work, sink, run_dir(spark, "triage-checkpoint"), available_now=True,
    )
    job.awaitTermination()
    return read_sink(spark, sink)


@query("tr3_triage_stream")
def _tr3(spark, sf):
    """The same triage over the conversations read as a stream."""
    model = final_model(spark, sf)
    return _streamed(spark, sf, lambda batch: triage.triage_final(batch, model))


# Everything but the classifier, checked exactly: the intent of a message is its silver
# label and the confidence follows from its length.


def _given(rows, text="message"):
    return rows.select(
        "message_id", labelling.silver_intent(text).alias("predicted_intent"),
        ((F.length("message") * 7) % 101 / F.lit(100e0)).alias("prediction_confidence"),
    )


def _intent_of(text: str) -> str:
    return q.cascade(f"lower({text})", lx.SILVER_INTENTS, "unknown")


def _confidence_of(text: str) -> str:
    return f"((length({text}) * 7) % 101) / 100e0 AS confidence"


def _tens(score: str) -> str:
    """A score of six places in ten-thousandths, from whole millionths, half up."""
    return f"((round({score} * 1000000)::BIGINT + 50) // 100)"


def _four(score: str) -> str:
    return f"{_tens(score)} / 10000e0"


def _top_sql(key: str, k: int) -> str:
    """The k best cases per message, filled up with the smallest ids at score 0."""
    return f"""scored AS (
  SELECT b.message_id, g.{key}, round(sum(b.weight * g.weight), 6) AS score
  FROM b_w b JOIN g_w g USING (term) GROUP BY ALL),
found AS (SELECT * FROM (
  SELECT a.message_id, a.intent AS predicted, c.*, coalesce(s.score, 0e0) AS score,
    row_number() OVER (PARTITION BY a.message_id ORDER BY coalesce(s.score, 0e0) DESC, c.{key})
      AS rank
  FROM asked a CROSS JOIN cases c
  LEFT JOIN scored s ON s.message_id = a.message_id AND s.{key} = c.{key}) WHERE rank <= {k})"""


_DEMO_SQL = q.with_(
    q.TWEETS, q.PAIRS,
    f"cases AS (SELECT brand_tweet_id AS id, customer_text AS customer, {q.SILVER} AS intent, "
    f"brand_response AS brand_reply FROM pairs WHERE {q.SILVER} <> 'unknown')",
    f"asked AS (SELECT tweet_id AS message_id, text AS message, lower(text) AS low, "
    f"{_intent_of('text')} AS intent, {_confidence_of('text')} FROM tweets WHERE inbound)",
    tfidf_sql("cases", "id", "customer", features.DEMO, "g"),
    grams_sql("asked", "message_id", "message", features.DEMO, "b"),
    weights_sql("g", "b_tf", "message_id", "b_w"), _top_sql("id", lx.DEMO_TOP_K),
    "best AS (SELECT a.*, f.score AS similarity, f.intent AS case_intent, f.brand_reply "
    "FROM asked a LEFT JOIN found f ON f.message_id = a.message_id AND f.rank = 1)",
)


@query(
    "tr1_triage_demo_given",
    _DEMO_SQL
    + f"""SELECT message_id, intent, round(confidence, 4) AS confidence,
  CASE WHEN {_RISK} IS NOT NULL OR confidence < 0.58 OR similarity < 0.2 OR {_OPEN} IS NOT NULL
    THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS action,
  CASE WHEN {_RISK} IS NOT NULL THEN 'High-risk signal detected: ''' || {_RISK} || '''.'
    WHEN confidence < 0.58 THEN printf('Low intent confidence (%.2f).', confidence)
    WHEN similarity < 0.2 THEN {q.lit(lx.DEMO_REASON_WEAK)}
    WHEN {_OPEN} IS NOT NULL THEN 'Possible repeated/unresolved contact: ''' || {_OPEN} || '''.'
    ELSE {q.lit(lx.DEMO_REASON_AUTO)} END AS reason,
  CASE WHEN similarity < 0.2 THEN {q.lit(lx.DEMO_REPLY_CLARIFY)}
    WHEN intent <> case_intent THEN {q.lit(lx.DEMO_REPLY_GENERIC)} ELSE brand_reply END AS draft_reply,
  (SELECT string_agg(f.intent || ':' || {_tens('f.score')} || ':' || f.customer, '|'
    ORDER BY f.rank) FROM found f WHERE f.message_id = best.message_id) AS evidence
FROM best""",
)
def _tr1_given(spark, sf):
    messages = cut_lineage(_messages(fx.tweets(spark, sf), _contexts(spark, sf)))
    model = demo_model(spark, sf, fit=None)
    out = triage.triage_demo(messages, model, intents=_given(messages))
    similarity = "similarity"
    shown = F.transform(
        "evidence",
        lambda e: F.concat_ws(
            ":", e["intent"], F.round(e[similarity] * 10000).cast("long").cast("string"), e["customer"]
        ),
    )
    return out.withColumn("evidence", F.array_join(shown, "|")).drop("message")


_BRAND_PREV = _PREV.replace("'Brand: '", q.lit(f"{fx.BRAND}: "))
_FINAL_CASES = f"""wide AS ({WIDE_SQL}),
ctx AS (SELECT customer_tweet_id, min({_BRAND_PREV}) AS context FROM wide GROUP BY ALL),
labels AS (SELECT customer_tweet_id, arg_max(silver_intent, brand_tweet_id) AS intent FROM split
  WHERE split = 'train' GROUP BY customer_tweet_id),
cases AS (SELECT w.brand_tweet_id, w.customer_tweet_id, w.customer_text, {q.strip('p.brand_response')} AS brand_response, l.intent,
    {q.clean_basic('w.customer_text')} || ' ' || {q.clean_basic(_BRAND_PREV)} AS retrieval_text
  FROM wide w JOIN labels l USING (customer_tweet_id) JOIN pairs p USING (brand_tweet_id))"""


def _final_sql(asked: str) -> str:
    """CTEs up to ``triaged``; ``asked`` gives message_id, message, context, intent."""
    terms = features.FINAL
    reply = " ".join(f"WHEN {q.lit(k)} THEN {q.lit(v)}" for k, v in lx.FINAL_REPLIES.items())
    return q.with_(
        q.TWEETS, q.PAIRS, THREADS_SQL, SPLIT_SQL, _FINAL_CASES, f"asked AS ({asked})",
        f"texts AS (SELECT message_id, {q.clean_basic('message')} || ' ' || "
        f"{q.clean_basic('context')} AS query FROM asked)",
        tfidf_sql("cases", "brand_tweet_id", "retrieval_text", terms, "g"),
        grams_sql("texts", "message_id", "query", terms, "b"),
        weights_sql("g", "b_tf", "message_id", "b_w"),
        _top_sql("brand_tweet_id", lx.FINAL_CANDIDATES),
        "picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY "
        "(intent = predicted) DESC, score DESC, brand_tweet_id) AS pick FROM found) WHERE pick = 1)",
        "rows AS (SELECT a.*, lower(a.message) AS low, coalesce(p.score, 0e0) AS similarity, "
        "p.customer_text, p.brand_response AS response, p.customer_tweet_id, p.brand_tweet_id "
        "FROM asked a LEFT JOIN picked p USING (message_id))",
        f"gated AS (SELECT *, {_FINAL_REASON} AS reason FROM rows)",
        f"""triaged AS (SELECT message_id, intent, round(confidence, 4) AS intent_confidence,
  {_four('similarity')} AS retrieval_similarity,
  CASE WHEN similarity >= 0.25 THEN 'YES' ELSE 'NO' END AS evidence_sufficient,
  {q.cascade("lower(coalesce(response, ''))", lx.FINAL_ACTIONS, 'information')} AS action,
  {_HANDLING} AS handling, reason,
  CASE intent {reply} ELSE {q.lit(_DEFAULT)} END
    || CASE WHEN regexp_matches(response, {q.lit(tx.URL)}) THEN {q.lit(lx.FINAL_REPLY_URL)}
      || regexp_extract(response, {q.lit(tx.URL)}) ELSE '' END
    || CASE WHEN {_HANDLING} = 'ESCALATE' THEN {q.lit(lx.FINAL_REPLY_ROUTED)} ELSE '' END AS reply,
  coalesce(customer_text, '') AS evidence_customer, coalesce(response, '') AS evidence_response,
  coalesce(customer_tweet_id, '') AS evidence_customer_tweet_id,
  coalesce(brand_tweet_id, '') AS evidence_brand_tweet_id
  FROM gated)""",
    )


_TRIAGED = _final_sql(
    f"SELECT t.tweet_id AS message_id, t.text AS message, coalesce(c.context, '') AS context, "
    f"{_intent_of('t.text')} AS intent, {_confidence_of('t.text')} FROM tweets t "
    "LEFT JOIN ctx c ON c.customer_tweet_id = t.tweet_id WHERE t.inbound"
) + "SELECT * FROM triaged"


@query("tr2_triage_final_given", _TRIAGED)
def _tr2_given(spark, sf):
    messages = cut_lineage(_messages(fx.tweets(spark, sf), _contexts(spark, sf)))
    model = final_model(spark, sf, fit=None)
    return triage.triage_final(messages, model, intents=_given(messages))


@query("tr3_triage_stream_given", _TRIAGED)
def _tr3_given(spark, sf):
    model = final_model(spark, sf, fit=None)
    return _streamed(spark, sf, lambda b: triage.triage_final(b, model, intents=_given(b)))


def _predicted(asked: str) -> str:
    """``asked`` (message_id, message, context) with the intent and confidence of the
    class-mean classifier of the training split."""
    return f"""WITH m AS ({asked}),
  tr AS (SELECT brand_tweet_id, {q.clean_basic('customer_text')} AS text, silver_intent
    FROM split WHERE split = 'train'),
  mt AS (SELECT message_id, {q.clean_basic('message')} AS text FROM m),
  {class_means_sql('tr', 'brand_tweet_id', 'silver_intent', 'mt', 'message_id', features.FINAL)}
  SELECT m.*, s.predicted AS intent, s.confidence FROM m JOIN scored_means s USING (message_id)"""


_MESSAGES_SQL = (
    "SELECT t.tweet_id AS message_id, t.text AS message, coalesce(c.context, '') AS context "
    "FROM tweets t LEFT JOIN ctx c ON c.customer_tweet_id = t.tweet_id WHERE t.inbound"
)


@query("tr2_triage_final_means", _final_sql(_predicted(_MESSAGES_SQL)) + "SELECT * FROM triaged")
def _tr2_means(spark, sf):
    """Triage with a fitted classifier that SQL can fit as well."""
    messages = cut_lineage(_messages(fx.tweets(spark, sf), _contexts(spark, sf)))
    return triage.triage_final(messages, final_model(spark, sf, models.fit_class_means))


# The golden rows carry the silver label of the message; the given intent is that of the
# reply, so that both agree only sometimes.
_GOLD_GATE = "CASE " + " ".join(
    f"WHEN {c.replace('intent', 'gold_intent')} THEN 'ESCALATE'"
    for c, n in _FINAL_CHECKS if n != "evidence"
) + " ELSE 'AUTO-HANDLE' END"
_EVALUATED = _final_sql(
    f"SELECT s.brand_tweet_id AS message_id, s.customer_text AS message, "
    f"coalesce(c.context, '') AS context, {_intent_of('s.brand_response')} AS intent, "
    f"{_confidence_of('s.customer_text')}, s.silver_intent AS gold_intent, "
    "s.brand_response AS gold_response "
    "FROM split s LEFT JOIN ctx c USING (customer_tweet_id) WHERE s.split = 'validation'"
).rstrip() + f""",
golden AS (SELECT *, {_GOLD_GATE} AS gold_handling FROM (SELECT *, lower(message) AS low FROM asked)),
evaluated AS (
  SELECT t.* EXCLUDE (intent, action, handling, evidence_sufficient), g.gold_intent,
    {q.cascade("lower(g.gold_response)", lx.FINAL_ACTIONS, 'information')} AS gold_action,
    g.gold_handling, 'YES' AS gold_evidence_sufficient, t.intent AS pred_intent,
    t.evidence_sufficient AS pred_evidence_sufficient, t.action AS pred_action,
    t.handling AS pred_handling
  FROM triaged t JOIN golden g USING (message_id))
"""


def _evaluated_given(spark, sf):
    golden = cut_lineage(_golden(spark, sf))
    replies = fx.pairs(spark, sf).select(F.col("brand_tweet_id").alias("message_id"), "brand_response")
    intents = _given(golden.join(replies, "message_id"), "brand_response")
    model = final_model(spark, sf, fit=None)
    return triage.golden_eval(golden, triage.triage_final(golden, model, intents=intents))


@query("ev6_golden_predictions_given", _EVALUATED + "SELECT * FROM evaluated")
def _ev6_given(spark, sf):
    return _evaluated_given(spark, sf)


@query(
    "ev6_golden_accuracy_given",
    _EVALUATED
    + "SELECT round(avg((gold_intent = pred_intent)::DOUBLE), 6) AS intent_accuracy, "
    "round(avg((gold_action = pred_action)::DOUBLE), 6) AS action_accuracy, "
    "round(avg((gold_handling = pred_handling)::DOUBLE), 6) AS handling_accuracy, "
    "round(avg((gold_evidence_sufficient = pred_evidence_sufficient)::DOUBLE), 6) "
    "AS evidence_agreement FROM evaluated",
)
def _ev6a_given(spark, sf):
    found = report.golden_metrics(cut_lineage(_evaluated_given(spark, sf)))
    names = ["intent_accuracy", "action_accuracy", "handling_accuracy", "evidence_agreement"]
    return found.groupBy().pivot("key", names).agg(F.first("value"))


@query(
    "ev8_demo_evaluation_given",
    _DEMO_SQL
    + f"SELECT count(*) AS n, round(avg((b.intent = g.gold)::DOUBLE), 6) AS accuracy FROM best b "
    f"JOIN (SELECT customer_tweet_id AS message_id, {_intent_of('min(brand_response)')} AS gold "
    "FROM pairs GROUP BY ALL) g USING (message_id)",
)
def _ev8_given(spark, sf):
    """The demo agent against labelled messages: n and accuracy; the other figures are
    those of ev2 and ev3."""
    messages = cut_lineage(_messages(fx.tweets(spark, sf), _contexts(spark, sf)))
    out = triage.triage_demo(
        messages, demo_model(spark, sf, fit=None), intents=_given(messages)
    )
    replies = fx.pairs(spark, sf).groupBy(F.col("customer_tweet_id").alias("message_id")).agg(
        F.min("brand_response").alias("reply")
    )
    gold = replies.select("message_id", labelling.silver_intent("reply").alias("gold"))
    rows = cut_lineage(out.join(gold, "message_id").select("intent", "gold"))
    return report.demo_metrics(rows, "gold", "intent").where("section = 'metrics'").groupBy().pivot(
        "key", ["n", "accuracy"]
    ).agg(F.first("value")).select(F.col("n").cast("long").alias("n"), "accuracy")


def _golden(spark, sf):
    """Validation pairs as a golden set: silver intents and rule-made labels."""
    rows = silver_split(spark, sf).where("split = 'validation'").join(
        _contexts(spark, sf), F.col("customer_tweet_id") == F.col("context_id"), "left"
    ).select(
        F.col("brand_tweet_id").alias("message_id"), F.col("customer_text").alias("message"),
        F.coalesce("context", F.lit("")).alias("context"),
        F.col("silver_intent").alias("gold_intent"),
        gating.choose_action("brand_response").alias("gold_action"),
        F.lit("YES").alias("gold_evidence_sufficient"),
    )
    gate = gating.gate_final(F.col("message"), F.col("gold_intent"), F.lit(1e0))
    return rows.withColumn("gold_handling", gate["handling"])


def _evaluated(spark, sf):
    golden = cut_lineage(_golden(spark, sf))
    return triage.golden_eval(golden, triage.triage_final(golden, final_model(spark, sf)))


@query("ev6_golden_predictions")
def _ev6(spark, sf):
    return _evaluated(spark, sf)


@query("ev6_golden_metrics")
def _ev6m(spark, sf):
    return report.golden_metrics(cut_lineage(_evaluated(spark, sf)))
