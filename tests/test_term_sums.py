"""Document frequencies added up per batch of texts, weights by numbered words."""

import pytest
from pyspark.sql import functions as F

from threadlens.operators import features

TEXTS = [
    (1, "red blue red blue green"), (2, "blue red"), (3, None), (4, ""), (5, "the red the blue"),
    (6, "green green green"), (6, "red blue"), (7, "no such words"), (None, "blue green"),
]
SETTINGS = [
    features.TermSettings(), features.TermSettings(min_df=2, max_features=5),
    features.TermSettings(2, 0.9, 100, ("the", "no")),
]


def _docs(spark):
    return spark.createDataFrame(TEXTS, "id int, text string").repartition(3)


@pytest.mark.parametrize("settings", SETTINGS)
@pytest.mark.parametrize("words", [2, 1_000])
def test_combined_counts_make_the_same_vocabulary(spark, settings, words, monkeypatch):
    monkeypatch.setattr(features, "_COMBINED_WORDS", words)
    n = F.lit(9.0)
    plain, combined = (
        features.vocabulary(
            features.term_counts(_docs(spark), "id", "text", settings, combined=c), n, settings
        )
        for c in (False, True)
    )
    assert combined.schema == plain.schema
    assert sorted(map(tuple, combined.collect())) == sorted(map(tuple, plain.collect()))


def test_no_task_adds_up_all_terms_of_its_texts(spark):
    counts = features.term_counts(_docs(spark), "id", "text", combined=True)
    plan = features.vocabulary(counts, F.lit(9.0))._jdf.queryExecution().sparkPlan().toString()
    before = plan[plan.index("RepartitionByExpression" if "RepartitionByExpression" in plan else "Exchange"):]
    assert "HashAggregate" in plan and "HashAggregate" not in before


@pytest.mark.parametrize("settings", SETTINGS[1:])
def test_weights_by_numbers_are_those_by_terms(spark, settings):
    docs = _docs(spark)
    fitted, own = features.fit_transform(docs, "id", "text", settings)
    counts = features.term_counts(docs, "id", "text", settings)
    want = features.weights(counts, fitted.terms, "id", settings.max_features)
    rows = [
        sorted((str(r.id), r.term, round(r.weight, 12)) for r in df.collect()) for df in (own, want)
    ]
    assert rows[0] == rows[1] and rows[0]


def test_an_empty_vocabulary_weighs_nothing(spark):
    settings = features.TermSettings(min_df=50, max_features=5)
    _, own = features.fit_transform(_docs(spark), "id", "text", settings)
    assert own.count() == 0
