"""The vector index and vector near-dedup against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm.vector_dedup import near_vectors
from threadlens.llm.vector_search import COPIES, build_index, search_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [
    (9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [1.0, None] * 8, 1),
    (9005, [float("nan")] * 16, 1), (9006, [float("inf")] * 16, 1), (None, [1.0] * 16, 1),
]


def made(n, seed=0, copies=60):
    """Vectors with near copies, and one vector that many rows share."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16))
    near = min(40, n // 2)
    base[n // 2 : n // 2 + near] = base[:near] + rng.normal(size=(near, 16)) * 0.04
    base[-copies:] = base[7]
    base *= rng.uniform(0.5, 2, (n, 1))
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 4) if i % 31 else None) for i, v in enumerate(base)]
    return rows


def unit_cosines(rows):
    x = np.array([v for _, v, _ in rows])
    length = np.linalg.norm(x, axis=1)
    return (x @ x.T) / np.outer(length, length)


@pytest.mark.parametrize("lists, block", [(1, 64), (9, 50)])
def test_links_match_brute_force(spark, lists, block):
    rows = made(500)
    df = spark.createDataFrame(rows + ODD, SCHEMA).repartition(4)
    found = near_vectors(df, cosine=0.98, lists=lists, block=block).collect()
    cosine = unit_cosines(rows)
    label = np.array([-1 if lb is None else lb for _, _, lb in rows])
    linked = (cosine >= 0.98) & (label[:, None] == label) & (label >= 0)
    np.fill_diagonal(linked, False)
    component = np.arange(len(rows))
    for _ in range(len(rows)):
        low = np.where(linked, component[None, :], len(rows)).min(1)
        new = np.minimum(component, low)
        if (new == component).all():
            break
        component = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert len(found) == len(rows) + len(ODD)
    for i in range(len(rows)):
        assert got[i] == (linked[i].sum(), component[i], component[i] == i)
    for i in range(9001, 9007):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True)


def test_links_of_repeated_ids_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (1, [0.0, 2.0], 3), (2, [0.0, 1.0], 3),
            (3, [1.0], 3), (4, [1.0, 0.0], 4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("rep", "n", "vec", "c1", "list")})
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    # [1.0] counts as [1.0, 0.0].
    assert got == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 0, 4)]
    assert near_vectors(df.limit(0)).count() == 0


def best(rows, query, k):
    own, v, _ = rows[query]
    score = {}
    for i, x, _ in rows:
        if i != own:
            s = 0.0
            for p, q in zip(v, x):
                s += p * q
            score[i] = s
    return sorted(score.items(), key=lambda t: (-t[1], t[0]))[:k]


def test_search_recall_scores_and_ties(spark):
    rows = made(1500, seed=3)
    df = spark.createDataFrame(rows + ODD, SCHEMA).repartition(4)
    queries = df.where(F.col("vec_id") % 20 == 0)
    found = {}
    for r in search_vectors(df, queries, k=20, lists=24).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == list(range(0, 1500, 20)) + [9000 + 20 * i for i in range(0)]
    hit = 0
    for q, got in found.items():
        got.sort()
        want = best(rows, q, 20)
        assert [g[0] for g in got] == list(range(1, 21))
        truth = dict(best(rows, q, 1500))
        assert all(s == pytest.approx(truth[v], rel=1e-12) for _, v, s in got)
        assert [(s, -v) for _, v, s in got] == sorted([(s, -v) for _, v, s in got], reverse=True)
        hit += len({v for _, v, _ in got} & {v for v, _ in want})
    assert hit / (20 * len(found)) >= 0.9


def test_search_in_all_lists_is_exact_when_candidates_are_few(spark):
    rows = made(40, seed=5, copies=5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in search_vectors(df, df.where("vec_id % 20 = 0"), k=60, lists=6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in (0, 20):
        assert [v for _, v in sorted(got[q])] == [v for v, _ in best(rows, q, 39)]


def test_search_odd_tables(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert search_vectors(df, df).count() == 0
    assert search_vectors(df.limit(0), df.limit(0)).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0], 1)], SCHEMA)
    assert search_vectors(one, one).count() == 0
    twice = spark.createDataFrame([(20, [1.0, 2.0], 1), (20, [3.0, 1.0], 1), (21, [1.0], 1)], SCHEMA)
    rows = search_vectors(twice.withColumn("id", F.lit(1)), twice).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows if r.query_id == 20] == [(20, 1, 21, 3.0)]


def test_graph_walk_finds_the_nearest_centers():
    rng = np.random.default_rng(2)
    index = build_index(rng.normal(size=(3000, 12)), 8.0, 3000, lists=120)
    x = np.column_stack([rng.normal(size=(50, 12)), np.zeros(50)])
    dist, ids = index.walk(x, 32)
    true = np.sqrt(((x[:, None] - index.centers[None]) ** 2).sum(2))
    nearest = np.argsort(true, axis=1)[:, :COPIES]
    hits = [len(set(a[:COPIES]) & set(b)) for a, b in zip(ids, nearest)]
    assert sum(hits) >= 0.95 * COPIES * 50
    assert np.allclose(dist[:, 0], np.take_along_axis(true, ids[:, :1], 1)[:, 0])


def test_an_id_on_many_near_rows_takes_one_place(spark):
    """100 rows of one id crowd the top; the list of 20 is complete all the same."""
    rng = np.random.default_rng(4)
    rows = [(5, (np.ones(8) + rng.normal(size=8) * 0.01).tolist()) for _ in range(100)]
    rows += [(100 + i, rng.normal(size=8).tolist()) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0] * 8)], "vec_id long, embedding array<double>")
    best = {}
    for i, x in rows:
        best[i] = max(best.get(i, -9e9), sum(x))
    want = sorted(best.items(), key=lambda v: (-v[1], v[0]))[:20]
    for lists in (1, 4):
        got = search_vectors(vectors, asked, k=20, lists=lists).orderBy("rank").collect()
        assert len(got) == len({r.vec_id for r in got}) == 20
        if lists == 1:
            assert [r.vec_id for r in got] == [i for i, _ in want]
