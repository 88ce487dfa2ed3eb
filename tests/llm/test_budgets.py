"""What the toxicity model is fitted on when one text is as long as most of the budget."""

import pytest
from pyspark.sql import functions as F
from threadlens.llm import toxicity


@pytest.mark.parametrize("long_label", [0, 1])
def test_a_long_text_does_not_end_the_sample(spark, monkeypatch, long_label):
    long = spark.range(300).select(F.concat(F.repeat(F.lit("lorem "), 150), "id").alias("text"))
    first = long.orderBy(F.xxhash64("text")).first()["text"]  # early in hash order
    rows = [(0, first, long_label), *((i, f"word{i} lorem ipsum", i % 2) for i in range(1, 61))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, m) for i, _, m in rows], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_subwords", lambda texts, y, **o: seen.append((list(texts), list(y))))
    short = sum(len(t) for _, t, _ in rows[1:])
    toxicity.fit_toxicity(docs, labels, chars=len(first) + short // 4)
    toxicity.fit_toxicity(docs, labels, chars=len(first) + short)
    texts, y = seen[0]
    assert first not in texts and len(texts) == 60 and y.count(0) == y.count(1) == 30
    assert sorted(seen[1][0]) == sorted(t for _, t, _ in rows)


def test_budget_is_kept_and_each_class_has_its_half():
    texts = [(1, 0, 40), (2, 0, 30), (3, 0, 10), (4, 1, 30), (5, 1, 60), (6, 0, 5), (7, 1, 11)]
    assert toxicity.within_budget(texts, 101) == [(1, 0), (3, 0), (4, 1), (6, 0), (7, 1)]
    assert toxicity.within_budget([(1, 0, 90), (2, 0, 20)], 100) == [(2, 0)]
    assert toxicity.within_budget([(1, 0, 90), (2, 1, 5)], 100) == [(1, 0), (2, 1)]
    assert toxicity.within_budget([], 100) == []
