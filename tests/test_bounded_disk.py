"""What passes over large tables shuffle and store."""

import json
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

from threadlens.llm import vector_search
from threadlens.operators import features, kmeans, topics


def test_a_vector_block_is_searched_at_a_time(spark, monkeypatch):
    """Vectors were shuffled once per block of queries in one job; floats became doubles."""
    pick = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in pick.normal(size=6)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 4 = 0")
    stores, plain = [], vector_search.store
    monkeypatch.setattr(
        vector_search, "store", lambda df, *args: stores.append(df) or plain(df, *args)
    )
    kinds, cut = [], vector_search.cut_lineage
    monkeypatch.setattr(
        vector_search, "cut_lineage", lambda df: kinds.append(df.schema.simpleString()) or cut(df)
    )
    found = []
    for block in (8_192, 30):
        stores.clear()
        monkeypatch.setattr(vector_search, "QUERY_ROWS", block)
        found.append(sorted(map(tuple, vector_search.search_vectors(vectors, queries, k=5, lists=8).collect())))
    assert found[0] == found[1] and len(found[0]) == 500
    assert len(stores) >= 4
    assert all("array<float>" in k for k in kinds if "vec:" in k)
    doubles = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    again = vector_search.search_vectors(doubles, doubles.where("vec_id % 4 = 0"), k=5, lists=8)
    assert sorted(map(tuple, again.collect())) == found[0]


def test_a_pass_sends_sums_of_few_tasks(spark, monkeypatch):
    rows = spark.range(800).select(
        F.array((F.col("id") % 3).cast("int")).alias("indices"), F.array(F.lit(1e0)).alias("values")
    ).repartition(60)
    asked, plain = [], kmeans.collected
    monkeypatch.setattr(
        kmeans, "collected",
        lambda df: asked.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df),
    )
    n, cost, total = kmeans._pass(rows, np.eye(3), [0, 3])
    assert n.tolist() == [267, 267, 266] and cost.sum() == 0 and total.sum() == 800
    assert f"Coalesce {2 * spark.sparkContext.defaultParallelism}" in asked[0]


def test_topic_vectors_are_stored_unscaled_and_once(spark):
    rows = [(1, "red apple pie"), (2, "blue sky"), (2, "red sky red"), (None, "apple pie"), (3, ""), (1, "pie")]
    docs = spark.createDataFrame(rows, "id int, clean_text string")
    feats = topics.topic_features(docs, "id", settings=features.TermSettings(1, 1.0, 50))
    want = topics.sparse_rows(docs.select("id"), "id", feats.weights, feats.terms, 50)
    got = [sorted((r.id or 0, tuple(r.indices), tuple(r["values"])) for r in df.collect()) for df in (feats.vectors, want)]
    assert got[0] == got[1] and len(got[0]) == 6
    stored = spark.read.parquet(*feats.vectors.inputFiles())
    assert stored.columns == ["id", "places", "raws", "length"]
    messages = topics.topic_messages(
        spark.createDataFrame([(1, "Red  apple pie!"), (0, "red apple pie"), (2, "ok")], "id int, t string"),
        ["id"], "t", columns=["id", "clean_text"],
    )
    assert [tuple(r) for r in messages.collect()] == [(0, "red apple pie")]


def test_a_shard_gets_only_its_own_lists_of_a_query(spark, monkeypatch):
    pick = np.random.default_rng(3)
    rows = [(i, pick.normal(size=4).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(vector_search, "SHARD_ROWS", 40)
    spread, plain = [], vector_search._shards
    monkeypatch.setattr(vector_search, "_shards", lambda *args: spread.append(plain(*args)) or spread[-1])
    sent, search = [], vector_search._search
    folder = tempfile.mkdtemp(prefix="run-")

    def watched(width, k):
        found = search(width, k)

        def look(frame):
            q = frame[frame["asks"].to_numpy(bool)]
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                json.dump([[int(s), [int(x) for x in x]] for s, x in zip(q["shard"], q["lists"])], f)
            return found(frame)

        return look

    monkeypatch.setattr(vector_search, "_search", watched)
    found = vector_search.search_vectors(vectors, vectors.where("vec_id % 3 = 0"), k=5, lists=12, coverage=1.0)
    assert found.count() == 500
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as f:
            sent += json.load(f)
    first, parts = spread[0]
    assert len({s for s, _ in sent}) > 1
    assert all(x and all(first[i] <= s < first[i] + parts[i] for i in x) for s, x in sent)
