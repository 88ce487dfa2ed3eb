"""Line dedup and source mixing against plain Python, with the odd inputs."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadlens.llm import mixing
from threadlens.llm.common import running_total, word_count
from threadlens.llm.line_dedup import LineRuns, dedup_lines
from threadlens.llm.mixing import mix_documents, mix_sources, source_targets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG = "a line that is long enough to count"
DOCS = [
    (1, f"{LONG}\nown words of one\n\n{LONG}"),
    (2, f" \t{LONG.upper()}\r\nshort"),
    (3, f"{LONG}\n{LONG}\nÄÖÜ {LONG}"),
    (4, f"Äöü {LONG}\nshort\nshort"),
    (5, f"äÖÜ {LONG}\nshort"),
    (6, None),
    (7, ""),
    (8, "\n\n"),
    (9, "\n".join(f"line number {i % 50} of a very long text" for i in range(5000))),
    (10, "\n".join(f"line number {i} of a very long text" for i in range(40))),
    (11, "line number 7 of a very long text"),
    (12, "x" * 300_000),
]


def expected_lines(docs, min_chars=20, min_docs=3):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UPPER, LOWER))

    holders = defaultdict(list)
    for doc_id, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(doc_id)
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs
            or max(holders[key(x)]) == doc_id
        ]
        out[doc_id] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2)])
def test_lines_match_brute_force(spark, batches, fanout):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    rows = dedup_lines(docs, batches=batches, fanout=fanout).collect()
    found = {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in rows}
    assert found == expected_lines(DOCS)


def test_lines_repeated_rows_null_ids_and_clashing_names(spark):
    rows = [(1, LONG), (1, LONG), (2, LONG), (None, LONG), (None, f"{LONG} of none"),
            (None, f"{LONG} of none"), (None, f"{LONG} of none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("row", "__lines", "__drops", "key", "last", "pos", "n_lines")}
    )
    found = dedup_lines(docs)
    assert found.columns[2:8] == ["row", "__lines", "__drops", "key", "last", "pos"]
    got = sorted((r.doc_id or 0, r.kept_text) for r in found.collect())
    # Document 2 is the largest; a key that only null ids hold stays in all of them.
    assert got == [(0, ""), *[(0, f"{LONG} of none")] * 3, (1, ""), (1, ""), (2, LONG)]


def test_lines_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_are_levelled_and_settled_keys_not_stored_again(spark):
    runs = LineRuns(spark, min_docs=2, fanout=2)
    keys = spark.createDataFrame([(b"k", 8), (b"k", 9), (b"m", 8)], "key binary, doc_id long")
    runs.add(keys)
    runs.add(spark.createDataFrame([(b"k", 1), (b"n", 1)], "key binary, doc_id long"))
    assert [len(x) for x in runs.levels] == [0, 1]  # two runs became one of the next level
    stored = {bytes(r.key): (r.docs, r.last) for r in runs.runs().collect()}
    assert stored == {b"k": (2, 9), b"m": (1, 8), b"n": (1, 1)}
    assert [(bytes(r.key), r.last) for r in runs.frequent().collect()] == [(b"k", 9)]


def test_running_total_over_hot_group(spark):
    rows = [(i, "hot" if i % 10 else None, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, v long").repartition(7)
    found = {r.i: r.t for r in running_total(df, ["i"], "v", "t", by=["g"]).collect()}
    sums = defaultdict(int)
    for i, g, v in rows:
        sums[g] += v
        assert found[i] == sums[g]


def expected_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / share for s in order}
        over = {s for s in order if s not in capped and target[s] >= 3 * sizes[s]}
        if not over or over | capped == set(order):
            return target
        capped |= over


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 400, "B": 30, None: 5, "ä": 900, "c": 0, "d": 55}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r.source: r.target for r in source_targets(df).collect()}
    for s, t in expected_targets(sizes).items():
        assert found[s] == pytest.approx(t)


def test_mix_reaches_targets_and_repeats(spark):
    rows = [(i, i, ["a", "b", None, "c"][i % 4], 5 + i % 11) for i in range(2000)]
    df = spark.createDataFrame(rows, "row long, doc_id long, source string, size long")
    got = mix_sources(df).collect()
    again = {r.row: r.copies for r in mix_sources(df.repartition(13)).collect()}
    assert {r.row: r.copies for r in got} == again
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)
    assert sum(taken.values()) <= sum(r[3] for r in rows)


def expected_mix(rows, seed=17):
    """One document after the other: it is taken if what is left of the target holds it."""
    size = {}
    for _, _, s, n in rows:
        size[s] = size.get(s, 0) + (n or 0)
    target = expected_targets(size)
    out, used = {}, defaultdict(int)
    key = lambda r: (hashlib.md5(f"{seed}:{r[1]}".encode()).hexdigest(), r[1], r[3] or 0, r[0])
    for row, _, s, n in sorted(rows, key=key):
        whole = int(target[s] // size[s]) if size[s] else 0
        fits = used[s] + (n or 0) <= target[s] - whole * size[s] + 1e-6
        if n and fits:
            used[s] += n
        out[row] = whole + 1 if n and fits else whole if n else max(whole, 1)
    return out, target


@pytest.mark.parametrize("front", [1000, 3])
def test_mix_passes_over_what_does_not_fit(spark, monkeypatch, front):
    """Long documents early in a small source's queue cost it no more than themselves."""
    monkeypatch.setattr(mixing, "FRONT", front)
    pick = random.Random(9)
    rows, row = [], 0
    for s, many in (("hot", 400), ("a", 30), ("b", 25), (None, 40), ("z", 3), ("none", 2)):
        for _ in range(many):
            n = pick.choice([0, 1, 7, 20, 90, 700, 20_000]) if s != "none" else 0
            rows.append((row, row * 7 % 1009, s, n))
            row += 1
    df = spark.createDataFrame(rows, "row long, doc_id long, source string, size long")
    got = mix_sources(df.repartition(6)).collect()
    want, target = expected_mix(rows)
    assert {r.row: r.copies for r in got} == want
    taken, left = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.copies <= 3
        taken[r.source] += r.copies * r.size
        if r.size and r.copies * r.source_size < r.target:  # there was room for it once more
            left[r.source].append(r.size)
    for s, t in target.items():
        assert taken[s] <= t + 1e-6
        if left[s] and t < 3 * sum(r[3] for r in rows if r[2] == s):
            assert t - taken[s] <= min(left[s]) + 1


def test_mix_odd_rows(spark):
    rows = [(0, 1, "a", None), (1, 1, "a", 4), (2, 1, "a", 4), (3, None, None, 9), (4, 2, "b", 0)]
    df = spark.createDataFrame(rows, "row long, doc_id long, source string, size long")
    assert mix_sources(df).count() == 5
    assert mix_sources(df.limit(0)).count() == 0


def test_mixed_documents_keep_all_columns(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (i % 9), "s" + str(i % 3), i) for i in range(200)],
        "doc_id long, text string, source string, number long",
    ).withColumns({"row": F.lit(1), "turn": F.lit("t"), "size": word_count("text")})
    mixed = mix_documents(docs, "size")
    assert mixed.columns == docs.columns
    sizes = docs.select(F.col("doc_id").alias("row"), "doc_id", "source", "size")
    want = {r.row: r.copies for r in mix_sources(sizes).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    # Equal hashes aside, ids decide the order, so the copies agree.
    assert got == want
