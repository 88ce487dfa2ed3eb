"""Packed weights, retrieval by blocks of queries, and what stays on disk."""

import time

import numpy as np
from pyspark.sql import functions as F

from threadlens.operators import features, retrieval
from threadlens.session import cut_lineage

SETTINGS = features.TermSettings(1, 1.0, 200, ("the",))


def _docs(spark, n=90):
    pick = np.random.default_rng(4)
    texts = [" ".join(pick.choice([f"w{i}" for i in range(30)], 6)) for _ in range(n)]
    rows = [(f"{i:03d}", t) for i, t in enumerate([*texts, texts[0], "the", "", None])]
    rows += [("000", "once more"), (None, "w1 w2 w3"), (None, "w4")]
    return spark.createDataFrame(rows, "id string, text string").repartition(5)


def test_packed_weights_are_the_weights(spark):
    docs = _docs(spark)
    fitted = features.fit_tfidf(docs, "id", "text", SETTINGS).stored()
    terms = [r.term for r in fitted.terms.orderBy("term").collect()]
    want = {(r.id, r.term, r.weight) for r in fitted.transform(docs, "id", "text").collect()}
    rows = cut_lineage(features.packed_weights(fitted, docs, "id", "text"), **features.PACKED)
    got = [
        (r.id, terms[p], x) for r in rows.select("id", "places", features.scaled().alias("w")).collect()
        for p, x in zip(r.places, r.w)
    ]
    assert set(got) == want and len(got) == len(want)
    by_row = features.packed_weights(fitted, docs, "id", "text", by_row=True).collect()
    assert len(by_row) == docs.count()
    assert [len(r.places) for r in by_row if r.id is None] == [0, 0]
    assert len({(tuple(r.places), r.length) for r in by_row if r.id == "000"}) == 1
    assert all(list(r.places) == sorted(r.places) for r in by_row)


def test_packed_retrieval_in_blocks(spark, monkeypatch):
    docs = _docs(spark).where("id IS NOT NULL")
    asked = docs.withColumnRenamed("id", "q")
    fitted = features.fit_tfidf(docs, "id", "text", SETTINGS).stored()
    long = [cut_lineage(fitted.transform(d, k, "text")) for d, k in ((asked, "q"), (docs, "id"))]
    packed = [
        cut_lineage(features.packed_weights(fitted, d, k, "text"), **features.PACKED)
        for d, k in ((asked, "q"), (docs, "id"))
    ]
    found = []
    for weights, cells in ((long, 10**6), (packed, 10**6), (packed, 100)):
        monkeypatch.setattr(retrieval, "_CELLS", cells)
        rows = retrieval.retrieve(*weights, 4, "q", "id", queries=asked, cases=docs.dropDuplicates(["id"]))
        found.append(sorted(map(tuple, rows.collect())))
    assert found[0] == found[1] == found[2] and found[0]


def test_no_side_is_shuffled_for_a_block_of_queries(spark, monkeypatch):
    """Only the best cases are shuffled, however many blocks there are."""
    docs = _docs(spark).where("id IS NOT NULL")
    fitted = features.fit_tfidf(docs, "id", "text", SETTINGS).stored()
    weights = cut_lineage(features.packed_weights(fitted, docs, "id", "text").repartition(6), **features.PACKED)
    monkeypatch.setattr(retrieval, "_CELLS", 100)
    plans, plain = [], retrieval.store
    monkeypatch.setattr(
        retrieval, "store",
        lambda df, *args: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *args),
    )
    retrieval._scored(weights.withColumnRenamed("id", "q"), weights, 3, "q", "id")
    assert len(plans) > 1
    for plan in plans:
        assert "Exchange" not in plan[plan.index("MapInArrow"):] and plan.count("Exchange") == 1


def test_a_stored_table_leaves_no_shuffles(spark):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in (blocks.apply(i).name() for i in range(blocks.size())) if b.startswith("shuffle_")}

    before = shuffled()
    stored = cut_lineage(spark.range(1000).repartition(4, F.col("id") % 7))
    for _ in range(50):  # files are removed in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and stored.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
