"""Queries: text features, classifiers, topics and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions import text as tx
from threadlens.operators import evaluation, features, kmeans, models, topics
from threadlens.plans import baseline, report
from threadlens.session import cut_lineage
from threadlens.suite import fixtures as fx
from threadlens.suite import sql as q
from threadlens.suite.base import query
from threadlens.suite.io_text import GOLD_PRED, gold_and_pred
from threadlens.suite.relational import SPLIT_SQL, silver_split

# -- terms and weights in SQL -------------------------------------------------


def grams_sql(source: str, key: str, text: str, settings: features.TermSettings, name: str) -> str:
    """CTEs up to {name}_tf(key, term, tf)."""
    raw = f"lower({text})"
    if not settings.accents:
        raw = f"strip_accents({raw})"
    toks = f"regexp_extract_all({raw}, {q.lit(tx.TOKEN)})"
    if settings.stop_words:
        toks = (
            f"list_filter({toks}, lambda t: NOT list_contains({q.lits(settings.stop_words)}, t))"
        )
    return f"""{name}_t AS (SELECT {key}, {toks} AS t FROM {source}),
{name}_tf AS (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(list_concat(t,
      list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
    FROM {name}_t) GROUP BY {key}, term)"""


def tfidf_sql(source, key, text, settings, name) -> str:
    """CTEs up to {name}_w(key, term, weight) over the source's own vocabulary."""
    limits = [f"df >= {settings.min_df}"]
    if settings.max_df < 1:
        limits.append(f"df <= {settings.max_df}::DOUBLE * (SELECT count(*) FROM {source})")
    cap = ""
    if settings.max_features:
        cap = f"ORDER BY total_tf DESC, term LIMIT {settings.max_features}"
    return f"""{grams_sql(source, key, text, settings, name)},
{name}_vocab AS (
  SELECT term, df, ln((1 + (SELECT count(*) FROM {source})) / (1 + df)::DOUBLE) + 1 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM {name}_tf GROUP BY term)
  WHERE {' AND '.join(limits)} {cap}),
{weights_sql(name, f'{name}_tf', key, f'{name}_w')}"""


def weights_sql(vocab: str, counts: str, key: str, out: str) -> str:
    return f"""{out}_raw AS (
  SELECT {key}, term, (1 + ln(tf)) * idf AS raw FROM {counts} JOIN {vocab}_vocab USING (term)),
{out} AS (SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight
  FROM {out}_raw)"""


def class_means_sql(train, key, label, asked, asked_key, settings, sharpness=10) -> str:
    """CTEs up to scored_means(asked_key, predicted, confidence): ``asked`` scored by the
    mean term weights of the classes of ``train``; both have a column text."""
    return f"""{tfidf_sql(train, key, 'text', settings, 'cm')},
cm_n AS (SELECT {label} AS label, count(*)::DOUBLE AS n FROM {train} GROUP BY ALL),
cm_coef AS (
  SELECT w.term, t.{label} AS label, sum(w.weight) * {sharpness}e0 / any_value(n.n) AS coef
  FROM cm_w w JOIN {train} t USING ({key}) JOIN cm_n n ON n.label = t.{label} GROUP BY ALL),
{grams_sql(asked, asked_key, 'text', settings, 'cq')},
{weights_sql('cm', 'cq_tf', asked_key, 'cq_w')},
cm_z AS (
  SELECT a.{asked_key}, n.label, round(coalesce(s.z, 0), 12) AS z
  FROM {asked} a CROSS JOIN cm_n n
  LEFT JOIN (SELECT q.{asked_key}, c.label, sum(q.weight * c.coef) AS z
    FROM cq_w q JOIN cm_coef c USING (term) GROUP BY ALL) s
    ON s.{asked_key} = a.{asked_key} AND s.label = n.label),
scored_means AS (
  SELECT {asked_key}, arg_max(label, (z, -place)) AS predicted, 1 / sum(exp(z - top)) AS confidence
  FROM (SELECT *, max(z) OVER (PARTITION BY {asked_key}) AS top,
          row_number() OVER (PARTITION BY {asked_key} ORDER BY label) AS place FROM cm_z)
  GROUP BY {asked_key})"""


_DEMO, _BASE = features.DEMO, features.BASELINE


@query(
    "ml1_ngrams",
    q.with_(grams_sql("documents", "doc_id", "text", _DEMO, "g"))
    + "SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS total, "
    "md5(string_agg(term || '=' || tf, ',' ORDER BY term)) AS terms_md5 FROM g_tf GROUP BY doc_id",
)
def _ml1(spark, sf):
    counts = features.packed_counts(fx.table(spark, sf, "documents"), "doc_id", "text")
    by_term = F.sort_array(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))
    shown = F.transform(by_term, lambda t: F.concat(t["term"], F.lit("="), t["tf"].cast("string")))
    return counts.where(F.size("terms") > 0).select(
        "doc_id", F.size("terms").cast("long").alias("terms"),
        F.aggregate("tfs", F.lit(0).cast("long"), lambda a, n: a + n).alias("total"),
        F.md5(F.array_join(shown, ",")).alias("terms_md5"),
    )


_TOPIC = features.topic_settings()


@query(
    "ml2_vocabulary",
    q.with_(
        f"c AS (SELECT doc_id, {q.clean_topic('text')} AS t FROM documents)",
        grams_sql("c", "doc_id", "t", _TOPIC, "g"),
    )
    + "SELECT term, df, total_tf::BIGINT AS total_tf FROM (SELECT term, count(*) AS df, "
    "sum(tf) AS total_tf FROM g_tf GROUP BY term) WHERE df >= 20 AND df <= 0.8e0 * "
    "(SELECT count(*) FROM documents) ORDER BY total_tf DESC, term LIMIT 5000",
)
def _ml2(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", tx.clean_topic("text").alias("t"))
    counts = features.term_counts(docs, "doc_id", "t", _TOPIC, combined=True)
    n = fx.table(spark, sf, "documents").agg(F.count("*")).scalar()
    return features.vocabulary(counts, n, _TOPIC)


@query(
    "ml3_tfidf_weights",
    q.with_(tfidf_sql("documents", "doc_id", "text", _BASE, "g"))
    + "SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS weight_sum, "
    "round(max(weight), 6) AS weight_max FROM g_w GROUP BY doc_id",
)
def _ml3(spark, sf):
    w = features.tfidf(fx.table(spark, sf, "documents"), "doc_id", "text", _BASE)
    return w.groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("weight_sum"),
        F.round(F.max("weight"), 6).alias("weight_max"),
    )


@query(
    "ml4_top_terms",
    q.with_(
        f"c AS (SELECT doc_id, {q.clean_topic('text')} AS t FROM documents)",
        tfidf_sql("c", "doc_id", "t", _TOPIC, "g"),
    )
    + "SELECT term, round(sum(weight) / (SELECT count(*) FROM documents), 6) AS mean_weight "
    "FROM g_w GROUP BY term ORDER BY mean_weight DESC, term LIMIT 100",
)
def _ml4(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", tx.clean_topic("text").alias("t"))
    return features.top_terms(docs, "doc_id", "t")


# -- classifiers --------------------------------------------------------------


def _stored_split(spark, sf):
    return cut_lineage(silver_split(spark, sf))


@query("ml5_intent_classifier")
def _ml5(spark, sf):
    """Scored validation rows of the message-only baseline."""
    scored = baseline.run_baseline(_stored_split(spark, sf))
    return scored.select(
        "brand_tweet_id", "silver_intent", "predicted_intent",
        F.round("prediction_confidence", 6).alias("prediction_confidence"),
    )


@query(
    "ml6_class_weights",
    "WITH c AS (SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority) "
    "SELECT o_orderpriority, count, round((SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) "
    "* count), 9) AS weight FROM c",
)
def _ml6(spark, sf):
    w = features.class_weights(fx.table(spark, sf, "orders"), "o_orderpriority")
    return w.withColumn("weight", F.round("weight", 9))


@query("ml7_scored_metrics")
def _ml7(spark, sf):
    """Metrics table of a scored run: fit on the training split, score everything."""
    split = _stored_split(spark, sf)
    model = models.fit_intent(
        split.where("split = 'train'"), "brand_tweet_id", "customer_text", "silver_intent"
    )
    scored = model.score(
        split.select("brand_tweet_id", "customer_text", "silver_intent"),
        "brand_tweet_id", "customer_text",
    )
    return report.classification_metrics(
        cut_lineage(scored), "silver_intent", "predicted_intent", "prediction_confidence",
        lx.INTENT_LABELS,
    )


@query(
    "ml7_class_mean_scores",
    q.with_(
        q.TWEETS, q.PAIRS, SPLIT_SQL,
        "tr AS (SELECT brand_tweet_id, customer_text AS text, silver_intent FROM split "
        "WHERE split = 'train')",
        "asked AS (SELECT brand_tweet_id AS id, customer_text AS text, silver_intent FROM split)",
        class_means_sql("tr", "brand_tweet_id", "silver_intent", "asked", "id", _BASE),
    )
    + "SELECT id AS brand_tweet_id, silver_intent, predicted AS predicted_intent, "
    "round(confidence, 6) AS prediction_confidence FROM asked JOIN scored_means USING (id)",
)
def _ml7_means(spark, sf):
    """The relational scoring, with coefficients that SQL can compute: class means."""
    split = _stored_split(spark, sf)
    model = models.fit_class_means(
        split.where("split = 'train'"), "brand_tweet_id", "customer_text", "silver_intent"
    )
    scored = model.score(
        split.select("brand_tweet_id", "customer_text", "silver_intent"),
        "brand_tweet_id", "customer_text",
    )
    return scored.select(
        "brand_tweet_id", "silver_intent", "predicted_intent",
        F.round("prediction_confidence", 6).alias("prediction_confidence"),
    )


@query("ml8_context_classifier")
def _ml8(spark, sf):
    pairs = cut_lineage(fx.pairs(spark, sf))
    scored = baseline.run_context_baseline(pairs, _stored_split(spark, sf), fx.BRAND)
    return scored.select(
        "brand_tweet_id", "silver_intent", "predicted_intent",
        F.round("prediction_confidence", 6).alias("prediction_confidence"),
    )


# -- topics -------------------------------------------------------------------


def _topic_features(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "text")
    messages = topics.topic_messages(docs, ["doc_id"], "text", columns=["doc_id", "clean_text"])
    return topics.topic_features(messages, "doc_id")


@query("ml9_topic_clusters")
def _ml9(spark, sf):
    assigned, _ = topics.topics(_topic_features(spark, sf), 8)
    return topics.cluster_sizes(assigned)


@query("ml10_topic_silhouette")
def _ml10(spark, sf):
    feats = _topic_features(spark, sf)
    assigned, cost = topics.topics(feats, 10)
    assigned = cut_lineage(assigned)
    value = topics.silhouette(assigned, "doc_id", feats.size)
    return assigned.agg(
        F.lit(10).alias("k"), F.lit(round(value, 6)).alias("silhouette"),
        F.lit(round(cost, 6)).alias("cost"), F.count("*").alias("messages"),
    )


_LABELLED = (
    "a AS (SELECT doc_id, lang AS cluster FROM documents), n AS (SELECT cluster, count(*) AS n "
    "FROM a GROUP BY cluster), centers AS (SELECT cluster, term, sum(weight) / any_value(n) AS "
    "center FROM g_w JOIN a USING (doc_id) JOIN n USING (cluster) GROUP BY cluster, term)"
)
_KM = features.topic_settings(k_means=True)
_TOPIC_W = (
    f"c AS (SELECT doc_id, {q.clean_topic('text')} AS t FROM documents),\n"
    + tfidf_sql("c", "doc_id", "t", _KM, "g")
)


def _given_clusters(spark, sf):
    docs = fx.documents(spark, sf)
    w = features.tfidf(
        docs.select("doc_id", tx.clean_topic("text").alias("t")), "doc_id", "t", _KM
    )
    return cut_lineage(w), docs.select("doc_id", F.col("lang").alias("cluster"))


@query(
    "ml11_cluster_terms",
    q.with_(_TOPIC_W, _LABELLED)
    + "SELECT cluster, term, center, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER "
    "(PARTITION BY cluster ORDER BY center DESC, term) AS rank FROM "
    "(SELECT cluster, term, round(center, 6) AS center FROM centers)) WHERE rank <= 15",
)
def _ml11(spark, sf):
    return topics.cluster_terms(*_given_clusters(spark, sf), "doc_id")


@query(
    "ml12_cluster_examples",
    q.with_(_TOPIC_W, _LABELLED)
    + """, norms AS (SELECT cluster, sum(center * center) AS c2 FROM centers GROUP BY cluster),
d AS (SELECT a.doc_id, a.cluster, coalesce(sum(g.weight * g.weight), 0) AS x2,
    coalesce(sum(g.weight * c.center), 0) AS xc
  FROM a LEFT JOIN g_w g USING (doc_id) LEFT JOIN centers c
    ON c.cluster = a.cluster AND c.term = g.term GROUP BY a.doc_id, a.cluster)
SELECT cluster, doc_id, distance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, doc_id) AS rank FROM (
    SELECT cluster, doc_id, round(greatest(x2 + coalesce(c2, 0) - 2 * xc, 0), 6) AS distance
    FROM d LEFT JOIN norms USING (cluster))) WHERE rank <= 10""",
)
def _ml12(spark, sf):
    w, assigned = _given_clusters(spark, sf)
    return topics.cluster_examples(w, assigned, "doc_id")


# Stated centers: the weights of the eight messages with the smallest ids.
_STATED = (
    f"c AS (SELECT doc_id, {q.clean_topic('text')} AS t FROM documents),\n"
    + tfidf_sql("c", "doc_id", "t", _KM, "g")
    + """, seeds AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS cluster
  FROM documents ORDER BY doc_id LIMIT 8),
norm AS (SELECT d.doc_id, coalesce(sum(g.weight * g.weight), 0) AS x2
  FROM documents d LEFT JOIN g_w g USING (doc_id) GROUP BY d.doc_id),
apart AS (
  SELECT n.doc_id, s.cluster, round(greatest(n.x2 + c.x2 - 2 * coalesce(p.xc, 0), 0), 9) AS distance
  FROM norm n CROSS JOIN seeds s JOIN norm c ON c.doc_id = s.doc_id
  LEFT JOIN (SELECT x.doc_id, y.doc_id AS seed, sum(x.weight * y.weight) AS xc
    FROM g_w x JOIN g_w y USING (term) WHERE y.doc_id IN (SELECT doc_id FROM seeds) GROUP BY ALL) p
    ON p.doc_id = n.doc_id AND p.seed = s.doc_id)"""
)


def _all_rows(spark, sf):
    """The K-means features of all documents."""
    docs = fx.documents(spark, sf).select("doc_id", tx.clean_topic("text").alias("clean_text"))
    return topics.topic_features(docs, "doc_id")


@query(
    "ml9_assignment_step",
    q.with_(_STATED)
    + "SELECT doc_id, round(min(distance), 6) AS distance FROM apart GROUP BY doc_id",
)
def _ml9_step(spark, sf):
    """One assignment step: the nearest of stated centers and its squared distance."""
    return _nearest_stated(spark, sf).select("doc_id", F.round("distance", 6).alias("distance"))


@query(
    "ml9_stated_cost",
    q.with_(_STATED)
    + "SELECT count(*) AS messages, round(sum(d), 4) AS cost "
    "FROM (SELECT min(distance) AS d FROM apart GROUP BY doc_id)",
)
def _ml9_cost(spark, sf):
    found = _nearest_stated(spark, sf)
    return found.agg(
        F.count("*").alias("messages"), F.round(F.sum("distance"), 4).alias("cost")
    )


def _nearest_stated(spark, sf):
    feats = _all_rows(spark, sf)
    first = feats.vectors.select("doc_id").orderBy("doc_id").limit(8).select(
        F.col("doc_id").alias("seed"),
        (F.row_number().over(W.orderBy("doc_id")) - 1).alias("cluster"),
    )
    own = feats.weights.join(first, F.col("doc_id") == F.col("seed"))
    centers = own.select("cluster", "term", F.col("weight").alias("center"))
    return kmeans.nearest(feats.vectors, topics.stated_centers(feats, centers, 8))


@query(
    "ml10_silhouette_given",
    q.with_(_TOPIC_W)
    + """, norm AS (SELECT d.doc_id, d.lang AS cluster, coalesce(sum(g.weight * g.weight), 0) AS x2
  FROM documents d LEFT JOIN g_w g USING (doc_id) GROUP BY ALL),
dots AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.weight * y.weight) AS xy
  FROM g_w x JOIN g_w y USING (term) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
sums AS (
  SELECT x.doc_id, x.cluster, y.cluster AS other, count(*) AS n,
    sum(CASE WHEN x.doc_id = y.doc_id THEN 0
      ELSE sqrt(greatest(x.x2 + y.x2 - 2 * coalesce(d.xy, 0), 0)) END) AS apart
  FROM norm x CROSS JOIN norm y LEFT JOIN dots d ON d.a = x.doc_id AND d.b = y.doc_id GROUP BY ALL),
ab AS (
  SELECT doc_id, max(n) FILTER (other = cluster) AS own,
    sum(apart / greatest(n - 1, 1)) FILTER (other = cluster) AS a,
    min(apart / n) FILTER (other <> cluster) AS b
  FROM sums GROUP BY doc_id)
SELECT round(avg(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM ab""",
)
def _ml10_given(spark, sf):
    """The silhouette of given clusters (languages), by Euclidean distance, of all documents."""
    feats = _all_rows(spark, sf)
    langs = fx.documents(spark, sf).select(
        F.col("doc_id").alias("id"), F.col("lang").alias("cluster")
    )
    assigned = cut_lineage(
        feats.vectors.join(langs, F.col("doc_id") == F.col("id")).drop("id")
    )
    value = topics.silhouette(assigned, "doc_id", feats.size, sample=None)
    return assigned.limit(1).select(F.lit(round(value, 6)).alias("silhouette"))


@query("ml13_compare_k")
def _ml13(spark, sf):
    return topics.compare_k(_topic_features(spark, sf), "doc_id")


@query(
    "ml14_majority_baseline",
    "WITH top AS (SELECT o_orderpriority AS p FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 "
    "LIMIT 1) SELECT o_orderkey, o_orderpriority, (SELECT p FROM top) AS predicted_intent FROM orders",
)
def _ml14(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return models.majority_baseline(orders, orders, "o_orderpriority")


# -- metrics ------------------------------------------------------------------

_GP = q.with_(q.CONTEXTUAL, q.V2, GOLD_PRED)
_REPORT = """
, labels_seen AS (SELECT gold AS label FROM labelled UNION SELECT pred FROM labelled),
per AS (
  SELECT label, count(*) FILTER (gold = label) AS support,
    count(*) FILTER (pred = label) AS predicted,
    count(*) FILTER (gold = label AND pred = label) AS hit
  FROM labels_seen CROSS JOIN labelled GROUP BY label),
rep AS (
  SELECT label, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall,
    2 * hit / (support + predicted) AS f1, support
  FROM per)
"""


@query(
    "ev1_accuracy",
    _GP + "SELECT round(avg((gold = pred)::DOUBLE), 6) AS accuracy FROM labelled",
)
def _ev1(spark, sf):
    return evaluation.accuracy(gold_and_pred(spark, sf), "gold", "pred")


@query(
    "ev2_class_report",
    _GP + _REPORT
    + "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(f1, 6) AS f1, support FROM rep",
)
def _ev2(spark, sf):
    return evaluation.class_report(gold_and_pred(spark, sf), "gold", "pred")


@query(
    "ev3_f1_summary",
    _GP + _REPORT
    + "SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) "
    "AS weighted_f1 FROM rep",
)
def _ev3(spark, sf):
    return evaluation.f1_summary(gold_and_pred(spark, sf), "gold", "pred")


@query(
    "ev4_confusion",
    _GP
    + f"SELECT g AS gold, p AS pred, (SELECT count(*) FROM labelled WHERE gold = g AND pred = p) "
    f"AS count FROM (SELECT unnest({q.lits(lx.INTENT_LABELS)}) AS g) CROSS JOIN "
    f"(SELECT unnest({q.lits(lx.INTENT_LABELS)}) AS p)",
)
def _ev4(spark, sf):
    return evaluation.confusion(gold_and_pred(spark, sf), "gold", "pred", lx.INTENT_LABELS)


@query(
    "ev4_confusion_matrix",
    _GP
    + "SELECT g AS gold, "
    + ", ".join(
        f"(SELECT count(*) FROM labelled WHERE gold = g AND pred = {q.lit(x)}) AS {x}"
        for x in lx.INTENT_LABELS
    )
    + f" FROM (SELECT unnest({q.lits(lx.INTENT_LABELS)}) AS g)",
)
def _ev4m(spark, sf):
    return evaluation.confusion_matrix(
        gold_and_pred(spark, sf), "gold", "pred", lx.INTENT_LABELS
    )


@query(
    "ev5_class_precision_recall",
    _GP
    + "SELECT round(count(*) FILTER (gold = 'delivery' AND pred = 'delivery') / count(*) FILTER "
    "(pred = 'delivery'), 6) AS precision, round(count(*) FILTER (gold = 'delivery' AND "
    "pred = 'delivery') / count(*) FILTER (gold = 'delivery'), 6) AS recall FROM labelled",
)
def _ev5(spark, sf):
    return evaluation.binary_pr(gold_and_pred(spark, sf), "gold", "pred", "delivery")

