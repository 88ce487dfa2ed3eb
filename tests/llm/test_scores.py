"""The two classifiers: held-out accuracy, odd rows, reruns."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import gam
from threadlens.llm.labelled import id_remainder, sampled_labels
from threadlens.llm.quality import FEATURES, fit_quality, quality_score, text_features
from threadlens.llm.toxicity import fit_subwords, fit_toxicity, toxicity_score

SYLLABLES = ["ka", "ro", "mi", "ten", "lu", "so", "pra", "vel", "no", "di"]


def sentence(rng, n):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def corpus(n=400, seed=1):
    """(doc_id, text, quality, toxic): junk is word soup with symbols; toxic texts hold a
    few words made from two stems with changing endings."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(sentence(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 12)))
        quality, toxic = int(i % 4 > 0), int(i % 5 == 0)
        if toxic:
            words = text.split()
            for _ in range(2):
                stem = rng.choice(["grobix", "zwupff"])
                words.insert(rng.randrange(len(words) + 1), stem + rng.choice(SYLLABLES) + rng.choice(SYLLABLES))
            text = " ".join(words)
        if not quality:
            text = " ".join(w + rng.choice(["###", "$$$", " |"]) for w in text.split())
        rows.append((i, text, quality, toxic))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    return rows, docs.cache(), labels.cache()


def test_quality_on_held_out_rows(spark, labelled):
    rows, docs, labels = labelled
    held_out = id_remainder("doc_id", 5) == 0
    model = fit_quality(docs, labels.where(~held_out))
    odd = spark.createDataFrame([(10_000, None), (10_001, ""), (None, "x " * 200_000)], docs.schema)
    scores = {r.doc_id: r.s for r in docs.unionByName(odd).select("doc_id", quality_score(model, "text").alias("s")).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[10_000] == scores[10_001]
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = [(scores[r[0]] >= 0.3) == (r[2] == 1) for r in test]
    assert len(test) > 50 and np.mean(right) >= 0.97


def test_toxicity_on_held_out_rows_and_unseen_endings(spark, labelled):
    rows, docs, labels = labelled
    held_out = id_remainder("doc_id", 4) == 2
    model = fit_toxicity(docs, labels.where(~held_out))
    extra = [(10_000, "Karo mi grobixxxen ten lu."), (10_001, "Karo mi ten lu so."), (10_002, None), (10_003, " \n")]
    all_docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    scores = {r.doc_id: r.s for r in all_docs.select("doc_id", toxicity_score(model, "text").alias("s")).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = [(scores[r[0]] >= 0.3) == (r[3] == 1) for r in test]
    assert len(test) > 50 and np.mean(right) >= 0.95
    assert scores[10_000] >= 0.3 > scores[10_001]
    assert scores[10_002] == scores[10_003] < 0.3
    assert all(0 <= s <= 1 for s in scores.values())


def test_toxic_word_in_a_very_long_text(spark):
    rows = corpus(300, seed=4)
    model = fit_subwords([r[1] for r in rows], np.array([r[3] for r in rows]))
    rng = random.Random(9)
    clean = " ".join(sentence(rng, 20) for _ in range(1500))
    toxic = clean + " grobixlumi zwupffkaro"
    df = spark.createDataFrame([(1, clean), (2, toxic)], "doc_id long, text string")
    scores = {r.doc_id: r.s for r in df.select("doc_id", toxicity_score(model, "text").alias("s")).collect()}
    assert scores[2] >= 0.3 and scores[2] > scores[1]


def test_fits_do_not_depend_on_row_order(labelled):
    _, docs, labels = labelled
    a, b = (fit_quality(docs.repartition(n), labels.repartition(n)) for n in (2, 7))
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables))


def test_models_without_rows_or_with_one_label(spark, labelled):
    _, docs, labels = labelled
    none = fit_quality(docs, labels.limit(0))
    assert none.scores(np.zeros((2, len(FEATURES)))) == pytest.approx([0.5, 0.5])
    one = fit_quality(docs, labels.withColumn("quality", F.lit(1)))
    assert one.scores(np.zeros((1, len(FEATURES))))[0] > 0.9
    nulls = fit_toxicity(docs, labels.withColumn("toxic", F.lit(None).cast("int")))
    assert docs.limit(0).select(toxicity_score(nulls, "text")).count() == 0


def test_sample_is_bounded_and_leaves_odd_labels_out(spark):
    rows = [(i % 700 if i % 3 else None, [0, 1, 2, None][i % 4]) for i in range(4000)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    for by_class in (True, False):
        got = sampled_labels(labels, "quality", 50, by_class).collect()
        assert 0 < len(got) <= 100 and all(r.label in (0, 1) and r.label_id is not None for r in got)


def test_features_are_finite_and_whole():
    for text in (None, "", "\n", "a", "Ä" * 9, "x " * 50_000, "\ud800"):
        values = text_features(text)
        assert len(values) == len(FEATURES) and np.isfinite(values).all()
    assert text_features("a " * 5000 + "#") != text_features("a " * 5000)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x[:2000], y[:2000])
    assert (0, 1) == model.pairs[0]
    assert (((model.scores(x[2000:]) >= 0.5) == (y[2000:] == 1)).mean()) >= 0.9
