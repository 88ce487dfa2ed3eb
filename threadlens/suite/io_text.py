"""Queries: sources, sinks, text functions, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.functions import lexicons as lx
from threadlens.functions import text as tx
from threadlens.operators import dedup, evaluation, frequency, goldset, labelling, profile
from threadlens.session import run_dir
from threadlens.sources import readers, writers
from threadlens.suite import fixtures as fx
from threadlens.suite import sql as q
from threadlens.suite.base import query

_ISO = "yyyy-MM-dd HH:mm:ss"


# -- sources and sinks --------------------------------------------------------


def _tweet_csv(spark, sf):
    path = run_dir(spark, "csv")
    writers.write_csv(fx.raw_tweets(spark, sf), path)
    return path


@query(
    "io1_read_message_csv",
    q.with_(q.TWEETS)
    + f"SELECT tweet_id, author_id, inbound, {q.text_time('created_at')} AS created_at, "
    "md5(text) AS text_md5, response_tweet_id, in_response_to_tweet_id FROM tweets",
)
def _io1(spark, sf):
    df = readers.typed_tweets(readers.read_tweets(spark, _tweet_csv(spark, sf)))
    return df.select(
        "tweet_id", "author_id", "inbound", F.date_format("created_at", _ISO).alias("created_at"),
        F.md5("text").alias("text_md5"), "response_tweet_id", "in_response_to_tweet_id",
    )


@query(
    "io2_read_csv_columns",
    q.with_(q.TWEETS)
    + "SELECT tweet_id, coalesce(in_response_to_tweet_id || '.0', '') AS in_response_to_tweet_id "
    "FROM tweets",
)
def _io2(spark, sf):
    return readers.read_tweets(
        spark, _tweet_csv(spark, sf), ["tweet_id", "in_response_to_tweet_id"]
    )


def _cases(spark, sf):
    p = fx.pairs(spark, sf)
    return p.select(
        F.col("brand_tweet_id").alias("id"), F.col("customer_text").alias("customer"),
        labelling.silver_intent("customer_text").alias("intent"),
        F.lit("").alias("resolution"), F.col("brand_response").alias("brand_reply"),
    )


@query(
    "io3_read_case_jsonl",
    q.with_(q.TWEETS, q.PAIRS)
    + f"SELECT brand_tweet_id AS id, customer_text AS customer, {q.SILVER} AS intent, "
    "'' AS resolution, brand_response AS brand_reply FROM pairs",
)
def _io3(spark, sf):
    path = run_dir(spark, "jsonl")
    writers.write_jsonl(_cases(spark, sf), path)
    return readers.read_cases(spark, path)


@query(
    "io4_resolve_columns",
    "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, source AS author FROM documents",
)
def _io4(spark, sf):
    d = fx.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("body"), F.col("source").alias("user_id")
    )
    return readers.resolve_text_author(d).select("doc_id", F.md5("text").alias("text_md5"), "author")


@query(
    "io5_required_columns",
    q.with_(q.TWEETS, q.PAIRS)
    + "SELECT customer_tweet_id, brand_tweet_id, md5(customer_text) AS customer_md5, "
    "md5(brand_response) AS brand_md5 FROM pairs",
)
def _io5(spark, sf):
    needed = ["customer_tweet_id", "brand_tweet_id", "customer_text", "brand_response"]
    p = readers.require_columns(fx.pairs(spark, sf), needed)
    return p.select(
        "customer_tweet_id", "brand_tweet_id", F.md5("customer_text").alias("customer_md5"),
        F.md5("brand_response").alias("brand_md5"),
    )


@query(
    "io6_csv_sink",
    q.with_(q.CONTEXTUAL)
    + "SELECT customer_tweet_id, brand_tweet_id, md5(conversation_context) AS context_md5, "
    "CAST(context_turn_count AS VARCHAR) AS context_turn_count FROM contextual",
)
def _io6(spark, sf):
    path = run_dir(spark, "csv")
    df = fx.contextual(spark, sf)
    writers.write_csv(df, path)
    back = readers.read_csv_strings(spark, path, df.columns)
    return back.select(
        "customer_tweet_id", "brand_tweet_id", F.md5("conversation_context").alias("context_md5"),
        "context_turn_count",
    )


@query(
    "io7_jsonl_sink",
    q.with_(q.TWEETS)
    + "SELECT tweet_id AS row_id, text, author_id AS author FROM tweets "
    "WHERE contains(lower(text), 'refund')",
)
def _io7(spark, sf):
    path = run_dir(spark, "jsonl")
    hits = profile.filter_mention(fx.tweets(spark, sf), "Refund")
    writers.write_jsonl(writers.json_rows(hits, "tweet_id", author="author_id"), path)
    return spark.read.schema("row_id string, text string, author string").json(path)


@query(
    "io8_metrics_json",
    "SELECT 'event_type' AS section, event_type AS key, CAST(count(*) AS DOUBLE) AS value "
    "FROM events GROUP BY event_type",
)
def _io8(spark, sf):
    freq = frequency.frequency(fx.table(spark, sf, "events"), "event_type")
    long = freq.select(
        F.lit("event_type").alias("section"), F.col("event_type").alias("key"),
        F.col("count").cast("double").alias("value"),
    )
    nested = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
    parsed = writers.metrics_to_json(long).select(F.from_json("json", nested).alias("m"))
    return parsed.select(F.explode("m").alias("section", "x")).select(
        "section", F.explode("x").alias("key", "value")
    )


# -- text, id and time functions ----------------------------------------------


@query(
    "fn1_norm_id",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) END AS id, "
    "CASE WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) ELSE '' END AS id_or_empty, "
    "CAST(value AS VARCHAR) IS NOT NULL AS has_value FROM events",
)
def _fn1(spark, sf):
    raw = F.when(
        F.col("event_type") != "error", F.concat(F.lit(" \t"), "event_id", F.lit(".0 "))
    )
    return fx.table(spark, sf, "events").select(
        "event_id", tx.norm_id(raw).alias("id"), tx.norm_id(raw, empty=True).alias("id_or_empty"),
        tx.norm_id("value").isNotNull().alias("has_value"),
    )


@query(
    "fn2_inbound_flag",
    "SELECT event_id, event_type IN ('view', 'click') AS inbound FROM events",
)
def _fn2(spark, sf):
    kind = F.col("event_type")
    raw = F.when(kind == "view", "True").when(kind == "click", "TRUE").when(
        kind == "error", "False"
    )
    return fx.table(spark, sf, "events").select("event_id", tx.as_bool(raw).alias("inbound"))


@query(
    "fn3_text_or_empty",
    "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality "
    "FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def _fn3(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id")
    return d.join(fx.table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", tx.text_or_empty("quality").alias("quality")
    )


def _document_md5(spark, sf, expr):
    return fx.documents(spark, sf).select(
        "doc_id", F.md5(expr).alias("text_md5"), F.length(expr).alias("n")
    )


def _document_sql(expr: str) -> str:
    return (
        f"WITH d AS (SELECT doc_id, {expr} AS t FROM documents) "
        "SELECT doc_id, md5(t) AS text_md5, length(t)::INTEGER AS n FROM d"
    )


_NOISY = (
    "'RT @émile_1 #Çok ' || text || ' &amp; https://x.example/é?q=1 www.y.example/a '"
    " || chr(160) || chr(8239)"
)


def _noisy():
    return F.concat(
        F.lit("RT @émile_1 #Çok "), "text",
        F.lit(" &amp; https://x.example/é?q=1 www.y.example/a "), F.lit("  "),
    )


@query("fn4_squash_whitespace", _document_sql(q.squash(_NOISY)))
def _fn4(spark, sf):
    return _document_md5(spark, sf, tx.squash_ws(_noisy()))


@query("fn5_trim_text", _document_sql(q.strip(f"chr(9) || text || {q.lit(' ')} || chr(160)")))
def _fn5(spark, sf):
    raw = F.concat(F.lit("\t"), "text", F.lit("  "))
    return _document_md5(spark, sf, tx.trim_text(raw))


@query("fn6_clean_basic", _document_sql(q.clean_basic(_NOISY)))
def _fn6(spark, sf):
    return _document_md5(spark, sf, tx.clean_basic(_noisy()))


@query("fn7_clean_topic", _document_sql(q.clean_topic(_NOISY)))
def _fn7(spark, sf):
    return _document_md5(spark, sf, tx.clean_topic(_noisy()))


@query("fn8_clean_sampling", _document_sql(q.clean_sampling(_NOISY)))
def _fn8(spark, sf):
    return _document_md5(spark, sf, tx.clean_sampling(_noisy()))


_LINES_SQL = (
    "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
)


def _lines(spark, sf):
    """Every line of every document: many short texts."""
    return fx.documents(spark, sf).select(
        "doc_id", F.explode(F.split("text", "\n")).alias("line")
    )


@query(
    "fn9_useful_messages",
    f"WITH {_LINES_SQL}, c AS (SELECT doc_id, {q.clean_topic('line')} AS t FROM lines) "
    f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({q.n_words('t')} >= 3 "
    "AND length(replace(t, ' ', '')) >= 5) AS useful FROM c GROUP BY doc_id",
)
def _fn9(spark, sf):
    c = _lines(spark, sf).withColumn("t", tx.clean_topic("line"))
    return c.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(tx.is_useful("t")).alias("useful")
    )


@query(
    "fn10_parse_time",
    f"SELECT event_id, CASE WHEN event_type = 'error' THEN NULL "
    f"ELSE {q.text_time('ts')} END AS parsed FROM events",
)
def _fn10(spark, sf):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", "yesterday")
        .when(kind == "view", F.date_format("ts", _ISO))
        .otherwise(F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy"))
    )
    return fx.table(spark, sf, "events").select(
        "event_id", F.date_format(tx.parse_ts(raw), _ISO).alias("parsed")
    )


@query(
    "fn11_extract_urls",
    f"SELECT page_id, len(u)::INTEGER AS n_urls, md5(array_to_string(u, ' ')) AS urls_md5 FROM "
    f"(SELECT page_id, regexp_extract_all(url || ' ' || html, {q.lit(tx.URL)}) AS u FROM pages)",
)
def _fn11(spark, sf):
    u = tx.urls(F.concat_ws(" ", "url", "html"))
    return fx.table(spark, sf, "pages").select(
        "page_id", F.size(u).alias("n_urls"), F.md5(F.array_join(u, " ")).alias("urls_md5")
    )


@query(
    "fn12_word_counts",
    f"SELECT doc_id, {q.n_words('text')} AS n_words, length(text)::INTEGER AS n_chars FROM documents",
)
def _fn12(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", tx.n_words("text").alias("n_words"), F.length("text").alias("n_chars")
    )


@query(
    "fn13_preview",
    "SELECT doc_id, left(text, 300) AS preview_300, left(text, 500) AS preview_500 FROM documents",
)
def _fn13(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", tx.preview("text", 300).alias("preview_300"),
        tx.preview("text", 500).alias("preview_500"),
    )


@query(
    "fn14_join_labels",
    q.with_(q.CONTEXTUAL, q.ANALYSIS)
    + f"SELECT brand_tweet_id, {q.joined('sig', ', ')} AS comma, {q.joined('sig', '|')} AS bar, "
    f"{q.joined('sig', ';')} AS semicolon FROM analysis",
)
def _fn14(spark, sf):
    df = labelling.label_analysis(fx.contextual(spark, sf), ["signals"])
    return df.select(
        "brand_tweet_id",
        *[
            tx.join_labels("escalation_signals", s).alias(n)
            for s, n in ((", ", "comma"), ("|", "bar"), (";", "semicolon"))
        ],
    )


@query(
    "fn15_count_flags",
    q.with_(q.CONTEXTUAL, q.V1)
    + "SELECT brand_tweet_id, len(sig)::INTEGER AS n_signals FROM v1",
)
def _fn15(spark, sf):
    df = labelling.label_v1(fx.contextual(spark, sf), ["signals"])
    return df.select("brand_tweet_id", tx.n_flags("escalation_signals", "|").alias("n_signals"))


# -- projections, filters and predicates --------------------------------------


@query(
    "fl1_mentions",
    "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the th')",
)
def _fl1(spark, sf):
    hits = profile.filter_mention(fx.table(spark, sf, "documents"), "THE Th")
    return hits.select("doc_id", "source")


@query(
    "fl2_one_account",
    q.with_(q.EVENT_TWEETS)
    + f"SELECT tweet_id, text FROM tweets WHERE author_id = '{fx.BRAND}'",
)
def _fl2(spark, sf):
    return profile.filter_author(fx.event_tweets(spark, sf), fx.BRAND).select("tweet_id", "text")


@query(
    "fl3_brand_replies",
    q.with_(q.TWEETS)
    + f"SELECT tweet_id, in_response_to_tweet_id, text FROM tweets "
    f"WHERE author_id = '{fx.BRAND}' AND NOT inbound",
)
def _fl3(spark, sf):
    return profile.brand_replies(fx.tweets(spark, sf), fx.BRAND).select(
        "tweet_id", "in_response_to_tweet_id", "text"
    )


@query(
    "fl4_usable_silver",
    q.with_(q.TWEETS, q.PAIRS)
    + f"SELECT * FROM (SELECT brand_tweet_id, {q.SILVER} AS silver_intent FROM pairs) "
    "WHERE silver_intent <> 'unknown'",
)
def _fl4(spark, sf):
    return labelling.usable_silver(fx.pairs(spark, sf)).select("brand_tweet_id", "silver_intent")


_CANDIDATE_COLUMNS = [
    "customer_tweet_id", "customer_author_id", "brand_tweet_id", "current_customer_message",
    "conversation_context", "historical_brand_response", "candidate_intent",
    "candidate_action", "escalation_signals", "context_turn_count", "ambiguity_score",
]


@query(
    "fl5_candidate_columns",
    q.with_(q.CONTEXTUAL, q.V1)
    + "SELECT customer_tweet_id, customer_author_id, brand_tweet_id, current_customer_message, "
    "conversation_context, historical_brand_response, candidate_intent, candidate_action, "
    f"{q.joined('sig', '|')} AS escalation_signals, context_turn_count, ambiguity_score FROM v1",
)
def _fl5(spark, sf):
    return labelling.label_v1(fx.contextual(spark, sf)).select(*_CANDIDATE_COLUMNS)


@query(
    "fl6_labelling_template",
    q.with_(q.TWEETS, q.PAIRS)
    + "SELECT customer_tweet_id, brand_tweet_id, customer_text, "
    + ", ".join(f"'' AS {c}" for c in lx.GOLD_COLUMNS)
    + " FROM pairs",
)
def _fl6(spark, sf):
    columns = ["customer_tweet_id", "brand_tweet_id", "customer_text", *lx.GOLD_COLUMNS]
    return goldset.labeling_template(fx.pairs(spark, sf), columns)


def gold_and_pred(spark, sf):
    """Two labels per message that disagree now and then: silver and v2 intent."""
    df = labelling.label_v2(fx.contextual(spark, sf), ["intent"])
    return df.select(
        "brand_tweet_id", labelling.silver_intent("current_customer_message").alias("gold"),
        F.col("candidate_intent").alias("pred"), "candidate_score",
    )


GOLD_PRED = (
    "labelled AS MATERIALIZED (SELECT brand_tweet_id, "
    + q.cascade("lower(current_customer_message)", lx.SILVER_INTENTS, "unknown")
    + " AS gold, candidate_intent AS pred, candidate_score FROM v2)"
)


@query(
    "fl7_mistakes",
    q.with_(q.CONTEXTUAL, q.V2, GOLD_PRED)
    + "SELECT brand_tweet_id, gold, pred, false AS correct FROM labelled WHERE gold <> pred",
)
def _fl7(spark, sf):
    wrong = evaluation.mistakes(gold_and_pred(spark, sf), "gold", "pred")
    return wrong.select("brand_tweet_id", "gold", "pred", "correct")


# -- set operations -----------------------------------------------------------


@query(
    "st1_concat_parts",
    "SELECT event_id, event_type, value, CAST(NULL AS BIGINT) AS user_id FROM events "
    "WHERE event_type = 'error' UNION ALL "
    "SELECT event_id, event_type, NULL, user_id FROM events WHERE event_type = 'click'",
)
def _st1(spark, sf):
    e = fx.table(spark, sf, "events")
    a = e.where("event_type = 'error'").select("event_id", "event_type", "value")
    b = e.where("event_type = 'click'").select("event_id", "event_type", "user_id")
    return dedup.concat_parts(a, b)


@query(
    "st2_dedup_keys",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER "
    "(PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
)
def _st2(spark, sf):
    e = fx.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return dedup.dedup(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "st3_dedup_cleaned_text",
    f"WITH {_LINES_SQL}, c AS (SELECT doc_id, {q.clean_sampling('line')} AS clean_text FROM lines) "
    "SELECT min(doc_id) AS doc_id, md5(clean_text) AS clean_md5 FROM c WHERE clean_text <> '' "
    "GROUP BY clean_text",
)
def _st3(spark, sf):
    kept = dedup.dedup_text(_lines(spark, sf), tx.clean_sampling("line"), ["doc_id", "line"])
    return kept.select("doc_id", F.md5("clean_text").alias("clean_md5"))
