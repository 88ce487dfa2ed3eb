import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.operators import (
    evaluation, features, frequency, gating, kmeans, models, retrieval, topics,
)
from threadlens.plans import triage
from threadlens.session import cut_lineage


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def brute_tfidf(texts, min_df=1, max_df=1.0):
    grams = []
    for t in texts:
        toks = [w for w in t.lower().split() if len(w) > 1]
        grams.append(toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])])
    n = len(texts)
    df = {}
    for g in grams:
        for term in set(g):
            df[term] = df.get(term, 0) + 1
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if min_df <= d <= max_df * n}
    out = []
    for g in grams:
        raw = {t: (1 + math.log(g.count(t))) * idf[t] for t in set(g) if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append({t: v / norm for t, v in raw.items()})
    return out


TEXTS = ["red blue blue", "blue green", "red", "", "blue blue red green green", "one word"]


@pytest.mark.parametrize("settings", [features.DEMO, features.TermSettings(2, 0.6, 100)])
def test_tfidf_against_brute_force(spark, settings):
    rows = features.tfidf(docs(spark, TEXTS), "id", "text", settings).collect()
    want = brute_tfidf(TEXTS, settings.min_df, settings.max_df)
    got = [{} for _ in TEXTS]
    for r in rows:
        got[r.id][r.term] = r.weight
    for g, w in zip(got, want):
        assert g.keys() == w.keys()
        assert all(math.isclose(g[t], w[t], rel_tol=1e-12) for t in w)


def test_counts_are_not_shuffled(spark, monkeypatch):
    """Rows of one id are one text, wherever batches end; weights need one shuffle, of texts."""
    monkeypatch.setattr(features, "_WORDS", 3)
    rows = [(i // 2 if i < 8 else None, f"aa b{i % 3}b cc aa b{i % 3}b") for i in range(10)]
    d = spark.createDataFrame(rows, "id int, text string")
    got = {(r.id, r.term): r.tf for r in features.term_counts(d, "id", "text").collect()}
    want = {}
    for i, text in rows:
        w = text.split()
        for term in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]:
            want[i, term] = want.get((i, term), 0) + 1
    assert got == want
    s = features.TermSettings(1, 1.0, 50)
    fitted = features.fit_tfidf(d, "id", "text", s).stored()
    plan = fitted.transform(d, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_common_terms_salted(spark):
    d = docs(spark, TEXTS)
    counts = features.term_counts(d, "id", "text")
    n = d.agg(F.count("*").cast("double")).scalar()
    vocab = features.vocabulary(counts, n).select("term", features.idf(F.col("df"), n).alias("idf"))
    plain = features.weights(counts, vocab, "id", 1000)
    salted = features.weights(counts, vocab, "id", None, hot_rows=2)
    near = plain.join(salted.withColumnRenamed("weight", "w2"), ["id", "term"])
    assert near.count() == plain.count() == salted.count()
    assert near.where(F.abs(F.col("weight") - F.col("w2")) > 1e-12).count() == 0


def test_vocabulary_cap_and_stop_words(spark):
    d = docs(spark, ["the cat the dog", "cat bird", "the the cat"])
    s = features.TermSettings(max_features=2, stop_words=("the",))
    n = d.agg(F.count("*").cast("double")).scalar()
    vocab = features.vocabulary(features.term_counts(d, "id", "text", s), n, s)
    # "cat" 3, then a tie of single terms, taken alphabetically
    assert [r.term for r in vocab.orderBy(F.desc("total_tf"), "term").collect()] == ["cat", "bird"]


def test_retrieval_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i:02d}" for i in range(25)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(120)]
    texts += [texts[0]] * 40  # a group of copies: ties go to the smaller id
    asked = [" ".join(rng.choice([*words, "zz"], 6)) for _ in range(15)] + ["zz zz"]
    corpus = docs(spark, texts)
    queries = spark.createDataFrame(list(enumerate(asked)), "q int, text string")
    fitted = features.fit_tfidf(corpus, "id", "text")
    case_w = fitted.transform(corpus, "id", "text")
    query_w = fitted.transform(queries, "q", "text")
    weights = {}
    for r in case_w.collect():
        weights.setdefault(r.id, {})[r.term] = r.weight
    want = {}
    for r in query_w.collect():
        for i, w in weights.items():
            if r.term in w:
                want.setdefault(r.q, {}).setdefault(i, 0.0)
                want[r.q][i] += r.weight * w[r.term]
    for k in (1, 5, 40, 2000):
        found = retrieval.retrieve(query_w, case_w, k, "q", "id", queries=queries, cases=corpus)
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r.q, r["rank"])):
            got.setdefault(r.q, []).append((-r.score, r.id))
        # A query without a known word gets the smallest ids at score 0.
        assert got == {
            q: sorted((-round(want.get(q, {}).get(i, 0.0), 6), i) for i in range(len(texts)))[:k]
            for q in range(len(asked))
        }
    assert 15 not in want


def test_retrieval_in_blocks(spark, monkeypatch):
    """The same result however the texts are cut into blocks."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(60)], 8)) for _ in range(90)]
    corpus = docs(spark, texts + texts[:30])
    weights = cut_lineage(features.tfidf(corpus, "id", "text"))
    asked = weights.withColumnRenamed("id", "q")
    found = []
    for cells, dense in ((10**6, 10**6), (150, 0)):
        monkeypatch.setattr(retrieval, "_CELLS", cells)
        monkeypatch.setattr(retrieval, "_DENSE", dense)
        monkeypatch.setattr(retrieval, "_AT_ONCE", 100 if dense else 10**6)
        rows = retrieval.retrieve(asked, weights, 4, "q", "id").collect()
        found.append(sorted((r.q, r["rank"], r.id, r.score) for r in rows))
    assert found[0] == found[1] and len(found[0]) == 480
    assert all(score == 1.0 for _, rank, _, score in found[0] if rank == 1)


def test_retrieval_shuffles_no_pairs(spark):
    """All texts share a word, so that adding up joined pairs would shuffle each of them."""
    corpus = docs(spark, [f"word w{i % 7}x w{i % 11}y" for i in range(300)])
    weights = cut_lineage(features.tfidf(corpus, "id", "text"))
    scored = retrieval._scored(weights.withColumnRenamed("id", "q"), weights, 3, "q", "id")
    assert scored.count() <= 300 * 3 * retrieval._SPREAD


def test_prefer_same_intent(spark):
    rows = spark.createDataFrame(
        [("a", 1, .9, "x", "y"), ("a", 2, .5, "y", "y"), ("a", 3, .5, "y", "y"),
         ("b", 1, .4, "x", "z"), ("b", 2, .4, "w", "z")],
        "q string, c int, score double, intent string, predicted_intent string",
    )
    got = retrieval.prefer_same_intent(rows, "q", "c").collect()
    assert {(r.q, r.c) for r in got} == {("a", 2), ("b", 1)}


def gate(spark, message, confidence, similarity):
    df = spark.createDataFrame([(message, confidence, similarity)], "m string, c double, s double")
    return df.select(gating.gate_demo(F.col("m"), F.col("c"), F.col("s")).alias("g")).first().g


def test_demo_gate_priorities(spark):
    assert gate(spark, "I will SUE again", .1, .1).reason == "High-risk signal detected: 'sue'."
    assert gate(spark, "again", .5, .1).reason == "Low intent confidence (0.50)."
    assert gate(spark, "again", .58, .1).reason == lx.DEMO_REASON_WEAK
    assert gate(spark, "again", .58, None).reason == lx.DEMO_REASON_WEAK
    assert gate(spark, "again", .58, .2).reason == "Possible repeated/unresolved contact: 'again'."
    auto = gate(spark, "hello", .58, .2)
    assert (auto.action, auto.reason) == ("AUTO_HANDLE", lx.DEMO_REASON_AUTO)


@pytest.mark.parametrize(
    ("message", "intent", "similarity", "reason"),
    [
        ("hacked, still", "delivery", .9, "security"),
        ("still", "account_access", .9, "account"),
        ("still", "delivery", .9, "order"),
        ("missing", "payment_billing", .9, "money"),
        ("hello", "customer_service_complaint", .1, "complaint"),
        ("hello", "delivery", .24, "evidence"),
        ("hello", "delivery", .25, "auto"),
        ("still", "information_general", .25, "auto"),
    ],
)
def test_final_gate(spark, message, intent, similarity, reason):
    df = spark.createDataFrame([(message, intent, similarity)], "m string, i string, s double")
    got = df.select(gating.gate_final(F.col("m"), F.col("i"), F.col("s")).alias("g")).first().g
    assert got.reason == lx.FINAL_REASONS[reason]
    assert got.handling == ("AUTO-HANDLE" if reason == "auto" else "ESCALATE")


def test_final_reply(spark):
    df = spark.createDataFrame([("see https://a.b/c and http://d",)], "r string")

    def reply(intent, escalate):
        return df.select(
            gating.reply_final(F.lit(intent), F.col("r"), F.lit(escalate), "Shop", "Acme")
        ).first()[0]

    assert reply("delivery", False) == lx.FINAL_REPLIES["delivery"] + " Relevant help: https://a.b/c"
    assert reply("other", True).startswith("Here’s the relevant guidance based on similar Shop cases")
    assert reply("other", True).endswith(lx.FINAL_REPLY_ROUTED)


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "g string, p string")


def test_metrics(spark):
    df = scored(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", "d")])
    report = {r.label: r for r in evaluation.class_report(df, "g", "p").collect()}
    assert report["a"].precision == 1.0 and report["a"].recall == 0.333333
    assert report["c"].f1 == 0.0 and report["c"].support == 1  # only in gold
    assert report["d"].f1 == 0.0 and report["d"].support == 0  # only predicted
    f1 = evaluation.f1_summary(df, "g", "p").first()
    assert f1.macro_f1 == round((0.5 + 0.5 + 0 + 0) / 4, 6)
    assert f1.weighted_f1 == round((0.5 * 3 + 0.5) / 5, 6)
    cells = evaluation.confusion(df, "g", "p", ["a", "b", "z"])
    assert cells.count() == 9 and cells.agg(F.sum("count")).first()[0] == 3
    right = scored(spark, [("x", "x"), ("y", "y")])
    assert evaluation.accuracy(right, "g", "p").first()[0] == 1.0
    assert evaluation.mistakes(right, "g", "p").count() == 0
    none = evaluation.binary_pr(right, "g", "p", "missing").first()
    assert (none.precision, none.recall) == (0.0, 0.0)


def test_frequencies(spark):
    df = scored(spark, [("a", "x")] * 2 + [("b", "x"), ("b", "y")])
    assert {r.g: (r["count"], r.percentage) for r in frequency.frequency(df, "g").collect()} == {
        "a": (2, 50.0), "b": (2, 50.0),
    }
    wide = {r.g: (r.x, r.y) for r in frequency.crosstab_pct(df, "g", "p", ["x", "y"]).collect()}
    assert wide == {"a": (100.0, 0.0), "b": (50.0, 50.0)}


@pytest.mark.parametrize(
    "values",
    [
        [3.0], [1.0, 2.0], [5.0, 1.0, 3.0], [1.0] * 50 + [2.0] * 50, [1.0] * 51 + [2.0] * 49,
        [float(i * i % 101) for i in range(400)], [7.0] * 300, [1.0, *[2.0] * 98, 9.0],
        [float(i) for i in range(1001)], [0.0] * 100 + [float(i) for i in range(1, 101)],
    ],
)
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(3)
    for few in (4, 20):
        assert frequency.exact_median(df, "x", few=few, bins=4) == float(np.median(values))
    assert frequency.exact_median(df, "x") == float(np.median(values))


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert frequency.exact_median(df, "x") is None
    assert frequency.confidence_stats(df, "x").first().median is None


TRAIN = [
    ("refund please my money", "refund"), ("i want a refund", "refund"), ("money refund now", "refund"),
    ("where is my parcel", "delivery"), ("parcel not here", "delivery"), ("late parcel", "delivery"),
    ("password login broken", "account"), ("cannot login password", "account"),
]


def cases(spark):
    return spark.createDataFrame(
        [(str(i), t, y, f"reply {i}") for i, (t, y) in enumerate(TRAIN)],
        "id string, customer string, intent string, brand_reply string",
    )


def test_classifier_beats_majority_and_repeats(spark):
    df = cases(spark)
    model = models.fit_intent(df, "id", "customer", "intent", features.DEMO)
    out = model.score(df, "id", "customer")
    assert evaluation.accuracy(out, "intent", "predicted_intent").first()[0] == 1.0
    base = models.majority_baseline(df, df, "intent")
    assert base.first().predicted_intent == "delivery"  # 3 and 3: first name
    again = models.fit_intent(df, "id", "customer", "intent", features.DEMO).score(
        df, "id", "customer"
    )
    a = {r.id: round(r.prediction_confidence, 6) for r in out.collect()}
    assert a == {r.id: round(r.prediction_confidence, 6) for r in again.collect()}
    unseen = spark.createDataFrame([("n", "xyzzy")], "id string, customer string")
    assert model.score(unseen, "id", "customer").count() == 1


def vectors_of(model, df):
    """MLlib vectors of the texts, terms in the order that fitting numbers them."""
    terms = models.indexed_terms(model.coefficients.select("term"))
    weights = model.tfidf.transform(df, "id", "customer")
    return models.to_vectors(df, "id", weights, terms, model.bound)


def test_relational_scores_equal_mllib(spark):
    df = cases(spark)
    model = models.fit_intent(df, "id", "customer", "intent", features.DEMO)
    extra = [("x", "xyzzy", "refund", ""), ("y", None, "refund", ""), ("z", "parcel refund login", "", "")]
    asked = df.unionByName(spark.createDataFrame(extra, df.schema)).withColumns(
        {"w": F.lit(1), "term": F.lit("t")}  # names that the scoring uses as well
    )
    there = {
        r.id: (r.prediction, r.probability.toArray())
        for r in model.solved.transform(vectors_of(model, asked)).collect()
    }
    here = model.score(asked, "id", "customer").collect()
    assert len(here) == len(there) == len(TRAIN) + 3
    for r in here:
        prediction, chance = there[r.id]
        assert r.predicted_intent == model.labels[int(prediction)]
        assert abs(r.prediction_confidence - chance.max()) < 1e-9


def test_class_means(spark):
    df = cases(spark)
    model = models.fit_class_means(df, "id", "customer", "intent", features.DEMO)
    weights = brute_tfidf([t for t, _ in TRAIN])
    want = {}
    for w, (_, label) in zip(weights, TRAIN):
        n = sum(y == label for _, y in TRAIN)
        for t, v in w.items():
            want[t, label] = want.get((t, label), 0.0) + 10 * v / n
    for r in model.coefficients.collect():
        assert r.w == pytest.approx([want.get((r.term, x), 0.0) for x in model.labels])
    out = model.score(df, "id", "customer")
    assert evaluation.accuracy(out, "intent", "predicted_intent").first()[0] == 1.0
    none = model.score(spark.createDataFrame([("n", "")], "id string, customer string"), "id", "customer")
    assert tuple(none.select("predicted_intent", F.round("prediction_confidence", 9)).first()) == (
        "account", round(1 / 3, 9),
    )


def test_classifier_matches_a_direct_solution(spark):
    """Same optimum as plain gradient descent on the balanced, C = 1 objective."""
    df = cases(spark)
    model = models.fit_intent(df, "id", "customer", "intent", features.DEMO)
    rows = vectors_of(model, df).orderBy("id").collect()
    x = np.array([r.features.toArray() for r in rows])
    labels = list(model.labels)
    y = np.array([labels.index(r.intent) for r in rows])
    counts = np.bincount(y)
    weight = (len(y) / (len(labels) * counts))[y]
    coef, bias = np.zeros((len(labels), x.shape[1])), np.zeros(len(labels))
    hot = np.eye(len(labels))[y]
    for _ in range(20000):
        z = x @ coef.T + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - hot) * weight[:, None]
        coef -= 0.05 * (g.T @ x + coef)
        bias -= 0.05 * g.sum(0)
    got = {r.id: r.prediction_confidence for r in model.score(df, "id", "customer").collect()}
    want = {r.id: p[i].max() for i, r in enumerate(rows)}
    assert all(abs(got[k] - want[k]) < 2e-3 for k in want)


def test_classifier_without_arrow(spark):
    name = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        model = models.fit_intent(cases(spark), "id", "customer", "intent", features.DEMO)
        assert model.coefficients.count() == model.bound
    finally:
        spark.conf.set(name, before)


def test_one_class_is_refused(spark):
    with pytest.raises(ValueError, match="two classes"):
        models.fit_intent(cases(spark).where("intent = 'refund'"), "id", "customer", "intent", features.DEMO)


def test_triage_demo(spark):
    model = triage.fit_demo(cases(spark))
    messages = spark.createDataFrame(
        [("1", "where is my parcel"), ("2", "nobody helped me and I am going to sue"), ("3", "xyzzy")],
        "message_id string, message string",
    )
    got = {r.message_id: r for r in triage.triage_demo(messages, model).collect()}
    assert got["1"].intent == "delivery"
    assert got["1"].evidence[0].similarity == 1.0
    assert got["2"].action == "ESCALATE" and "sue" in got["2"].reason
    # A message always gets its cases, at similarity 0 if it shares no term with any.
    assert [e.similarity for e in got["3"].evidence] == [0.0] * lx.DEMO_TOP_K
    assert got["3"].draft_reply == lx.DEMO_REPLY_CLARIFY


@pytest.fixture(scope="module")
def topic_feats(spark):
    rng = np.random.default_rng(8)
    words = [[f"{t}{i}" for i in range(12)] for t in "abcd"]
    texts = [" ".join(rng.choice(words[i % 4] + words[0][:2], 8)) for i in range(160)] + [""]
    d = docs(spark, texts).withColumnRenamed("text", "clean_text")
    return topics.topic_features(d, "id", settings=features.TermSettings(1, 1.0, 400))


def dense(feats):
    rows = feats.vectors.orderBy("id").collect()
    x = np.zeros((len(rows), feats.size))
    for i, r in enumerate(rows):
        x[i, r.indices] = r["values"]
    return x


def lloyd(x, centers, tol=1e-4):
    while True:
        apart = ((x[:, None] - centers[None]) ** 2).sum(2)
        own = apart.round(12).argmin(1)
        moved = np.stack([x[own == c].mean(0) if (own == c).any() else centers[c] for c in range(len(centers))])
        far = ((moved - centers) ** 2).sum(1).max()
        centers = moved
        if far <= tol * tol:
            return centers, ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum()


def test_shared_passes_equal_separate_fits(spark, topic_feats):
    runs = [(4, 1), (4, 2), (3, 5), (6, 1)]
    args = (topic_feats.size, ["id"])
    together = kmeans.fit_runs(topic_feats.vectors, runs, *args)
    x = dense(topic_feats)
    sample = topic_feats.vectors.orderBy("id").select("indices", "values").toArrow()
    rows = kmeans._batch(sample.combine_chunks().to_batches()[0])
    for (centers, cost), run in zip(together, runs):
        (alone, alone_cost), = kmeans.fit_runs(topic_feats.vectors, [run], *args)
        assert np.allclose(centers, alone) and abs(cost - alone_cost) < 1e-9
        plain, plain_cost = lloyd(x, kmeans._first_centers(rows, *run, topic_feats.size))
        assert np.allclose(centers, plain) and abs(cost - plain_cost) < 1e-6
    best, cost = topics.topics(topic_feats, 4, restarts=6)
    each = [kmeans.fit_runs(topic_feats.vectors, [(4, 42 + i)], topic_feats.size, [topics.tx.seeded_hash(42, "id"), "id"])[0][1]
            for i in range(6)]
    assert abs(cost - min(each)) < 1e-9
    assert abs(best.agg(F.sum("distance")).first()[0] - cost) < 1e-6


def test_all_starts_share_their_jobs(spark, topic_feats):
    spark.sparkContext.setJobGroup("passes", "passes")
    topics.best_topics(topic_feats, (3, 4, 5), restarts=10)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("passes")
    spark.sparkContext.setJobGroup("other", "other")
    assert len(jobs) <= 60  # thirty fits


def test_silhouette_against_brute_force(spark, topic_feats):
    x = dense(topic_feats)
    apart = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    for label in ("id % 3", "id % 2", "if(id = 7, 9, id % 4)", "1"):
        assigned = topic_feats.vectors.withColumn("cluster", F.expr(label))
        own = np.array([r.cluster for r in assigned.orderBy("id").collect()])
        values = []
        for i, c in enumerate(own):
            mine = own == c
            if mine.sum() == 1 or len(set(own)) == 1:
                values.append(0.0)
                continue
            a = apart[i, mine].sum() / (mine.sum() - 1)
            b = min(apart[i, own == d].mean() for d in set(own) if d != c)
            values.append((b - a) / max(a, b))
        got = topics.silhouette(assigned, "id", topic_feats.size)
        assert abs(got - np.mean(values)) < 1e-6
    few = topics.silhouette(topic_feats.vectors.withColumn("cluster", F.expr("id % 3")), "id", topic_feats.size, sample=20)
    assert -1 <= few <= 1
    assert topics.silhouette(topic_feats.vectors.limit(0).withColumn("cluster", F.lit(1)), "id", topic_feats.size) == 0.0


def test_stated_centers(spark, topic_feats):
    terms = [r.term for r in topic_feats.terms.orderBy("idx").limit(3).collect()]
    stated = spark.createDataFrame([(0, terms[0], 1.0), (1, terms[2], 0.5), (1, "unknown", 3.0)], "cluster int, term string, center double")
    got = topics.stated_centers(topic_feats, stated, 2)
    assert got.shape == (2, topic_feats.size) and got.sum() == 1.5 and got[0, 0] == 1.0 and got[1, 2] == 0.5


def test_topics(spark):
    texts = ["red apple pie"] * 12 + ["blue sky cloud"] * 12
    d = docs(spark, texts).withColumnRenamed("text", "clean_text")
    feats = topics.topic_features(d, "id", settings=features.TermSettings(2, 0.9, 50))
    assigned, cost = topics.topics(feats, 2, restarts=3)
    assert sorted(r["size"] for r in topics.cluster_sizes(assigned).collect()) == [12, 12]
    assert cost < 1e-6 and topics.silhouette(assigned, "id", feats.size) > 0.9
    first = {r.cluster: set() for r in assigned.collect()}
    for r in topics.cluster_terms(feats.weights, assigned, "id", 3).collect():
        first[r.cluster].add(r.term)
    # five terms of equal weight per cluster: the first three by name
    assert {frozenset(v) for v in first.values()} == {
        frozenset(["apple", "apple pie", "pie"]), frozenset(["blue", "blue sky", "cloud"]),
    }
    examples = topics.cluster_examples(feats.weights, assigned, "id", 4)
    assert examples.count() == 8 and examples.agg(F.max("distance")).first()[0] == 0.0
    table = topics.compare_k(feats, "id", (2, 3))
    assert [r.k for r in table.collect()] == [2, 3]
