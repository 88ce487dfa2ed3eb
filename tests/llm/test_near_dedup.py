"""SuperMinHash, near-duplicate documents and union-find against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import near_dedup
from threadlens.llm.graph import components
from threadlens.llm.near_dedup import near_duplicates
from threadlens.llm.superminhash import band_keys, shingle_set, signatures
from threadlens.session import cut_lineage


def plain_sets(text, words):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        parts = parts.replace(c, " ")
    parts = [w for w in parts.split(" ") if w]
    if len(parts) < words:
        return {tuple(parts)} if parts else set()
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def expected(docs, words, percent):
    sets = [(i, plain_sets(t, words)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: (len(s), root(i)) for i, s in sets}


def near_copies(seed=7, groups=12, members=9):
    """Groups whose members drift: neighbours are similar, the ends need not be."""
    rng = random.Random(seed)
    docs, doc_id = [], 100
    for g in range(groups):
        words = [f"w{g}x{rng.randint(0, 400)}" for _ in range(rng.choice([4, 30, 90, 400]))]
        for _ in range(members):
            docs.append((doc_id, " ".join(words)))
            doc_id += rng.randint(1, 9)
            for _ in range(max(1, len(words) // 25)):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("words", [2, 5])
def test_groups_match_brute_force(spark, words):
    docs = near_copies() + [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "oNE\r"), (6, "Én"),
                            (7, "én"), (8, "a b"), (9, "A\x0bB"), (10, "same " * 9000), (11, "same " * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = near_duplicates(df, words=words, percent=80).collect()
    want = expected(docs, words, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def one_bucket(spark, docs):
    """All classes in one bucket, compared with its first one."""
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = cut_lineage(df.mapInPandas(near_dedup._full_sets(2), "doc_id long, n long, set array<long>"))
    buckets = df.select(F.lit(1).cast("long").alias("key"), F.col("doc_id").alias("rep"))
    first = min(i for i, _ in docs)
    pairs = buckets.where(F.col("rep") != first).select(F.lit(first).alias("a"), F.col("rep").alias("b"))
    links = near_dedup._confirmed(pairs, sets, 80)
    known = components(links).withColumnRenamed("node", "n")
    groups = buckets.select(F.col("rep").alias("node")).join(known, F.col("node") == F.col("n"), "left")
    groups = cut_lineage(groups.select("node", F.coalesce("component", "node").alias("component")))
    return buckets, groups, sets


@pytest.mark.parametrize("seed", [3, 4])
def test_bucket_with_several_groups_is_finished(spark, seed):
    """One pass over the differences must find every link between groups."""
    docs = near_copies(seed=seed, groups=6, members=6)
    buckets, groups, sets = one_bucket(spark, docs)
    links = near_dedup._remaining(buckets, groups, sets, 80)
    group = {r.node: r.component for r in near_dedup._merged(groups, links).collect()}
    want = expected(docs, 2, 80)
    assert {i: group.get(i, i) for i, _ in docs} == {i: c for i, (_, c) in want.items()}


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """300 near copies of one text, of which many are linked with none: their pairs are
    neither made nor compared, and no link is lost."""
    pick = random.Random(6)
    base = [f"w{i}" for i in range(140)]
    docs = [(0, " ".join(base))]
    for i in range(1, 300):
        words = list(base)
        for at in pick.sample(range(140), pick.choice([2, 4, 5, 7, 9, 12, 16])):
            words[at] = f"x{i}-{at}" if pick.random() < 0.9 else "common"
        docs.append((i, " ".join(words)))
    buckets, groups, sets = one_bucket(spark, docs)
    compared, confirmed = [], near_dedup._confirmed

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_confirmed", counted)
    links = near_dedup._remaining(buckets, groups, sets, 80)
    group = {r.node: r.component for r in near_dedup._merged(groups, links).collect()}
    want = {i: c for i, (_, c) in expected(docs, 2, 80).items()}
    alone = [i for i, c in want.items() if i == c]
    assert group == want and 60 < len(alone) < 250
    assert sum(compared) < 2 * len(docs) < len(alone) * 100


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, text), (5, text), (5, other), (9, other), (3, text + " w61"), (None, text), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("rep", "key", "keys", "n", "set", "hash", "group")}
    )
    found = near_duplicates(df, words=2).collect()
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found)
    # Rows of 5 are one document, linked with 3 by one text and with 9 by the other.
    assert got == [(0, 0, True), (0, 0, True), (3, 3, True), *[(5, 3, False)] * 3, (9, 3, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_similarity_and_stop_early():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for size in (12, 300, 3000):
        a, b = np.unique(pool[:size]), np.unique(pool[size // 5 : size])
        values = signatures([a, b, np.empty(0, np.uint64), a], 240)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((values[0] == values[1]).mean() - true) < 0.12
        assert (values[0] == values[3]).all()
        # Every register is filled, each by its smallest offer.
        assert (values[:2] < np.iinfo(np.uint64).max).all()
        alone = signatures([a], 240)
        assert (alone[0] == values[0]).all()
    keys = band_keys(signatures([a, a, b], 240), 6)
    assert keys.shape == (3, 40) and (keys[0] == keys[1]).all() and len(set(keys[0])) == 40


def test_shingles_are_those_of_the_contract():
    for text in (None, "", "Ab", "AB ab", "É x\ty\x0bz\r\nÉ x", "a\x1cb c\x85d"):
        for words in (1, 2, 5):
            assert len(shingle_set(text, words)) == len(plain_sets(text, words))


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(2)
    path = [(i, i + 1) for i in range(1000, 1200)]
    star = [(5000, i) for i in range(2000, 2600)]
    ring = [(i, 3000 + (i - 2999) % 50) for i in range(3000, 3050)]
    loose = [(rng.randint(6000, 6400), rng.randint(6000, 6400)) for _ in range(260)]
    links = path + star + ring + loose + [(7000, 7000)]
    rng.shuffle(links)
    df = spark.createDataFrame([p if rng.random() < 0.5 else p[::-1] for p in links], "a long, b long")
    found = {r.node: r.component for r in components(df).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: root(x) for x in linked}
    assert components(df.limit(0)).count() == 0
