"""Hard negatives against plain Python: ties, hot labels, odd vectors, small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from threadlens.llm.hard_negatives import mine_hard_negatives, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, anchors, positives=5, negatives=3, low=50, high=95):
    import math

    sound = [
        (i, v, [math.floor(256 * x) for x in e], lab) for i, (v, e, lab) in enumerate(rows)
        if v is not None and e is not None and lab is not None
        and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for i, v, e, lab in sound:
        if v % anchors:
            continue
        found = sorted(
            (-sum(a * b for a, b in zip(e, f)), w, j, m) for j, w, f, m in sound if j != i
        )
        for s, w, _, m in [x for x in found if x[3] == lab][:positives]:
            fit = [x for x in found if x[3] != lab and -low * s <= -100 * x[0] <= -high * s]
            out += [(v, w, r, x[1], -s, -x[0]) for r, x in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, anchors, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = mine_hard_negatives(whole_vectors(frame, 256), F.col("vec_id") % anchors == 0, **options)
    return sorted(tuple(r) for r in found.collect())


def some_rows(seed, n=240, dim=6):
    pick = random.Random(seed)
    x = lambda: float(pick.choice([-0.5, 0.25, 0.5, 0.75, 1.0]))
    rows = [(i, [x() for _ in range(dim)], 0 if i % 3 == 0 else pick.randint(1, 5)) for i in range(n)]
    rows += [(i, [1.0] * dim, i % 2) for i in range(n, n + 40)]  # one very common vector
    rows += [(12, [0.5] * dim, 0), (12, [0.5] * dim, 0), (24, [0.5] * dim, 1)]  # repeated ids
    return rows


@pytest.mark.parametrize("block", [8_192, 16])
def test_matches_brute_force(spark, block):
    rows = some_rows(1)
    assert mined(spark, rows, 12, block_rows=block) == expected(rows, 12)
    assert mined(spark, rows, 40, positives=1, negatives=7, low=10, high=100, block_rows=block) == expected(
        rows, 40, 1, 7, 10, 100
    )


def test_odd_vectors_take_no_part_and_zero_scores_have_a_window(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 2), (3, [0.0, -1.0], 2),
        (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 2), (7, [inf, 0.0], 2), (8, [1.0, 0.0], None),
        (None, [1.0, 1.0], 1), (10, [0.0, 0.0], 1), (11, [], 2), (12, [1.0], 1), (13, [0.7], 2),
        (14, [-1.0, 0.0], 1), (20, [3e9, 0.0], 7),
    ]
    held = [r for r in rows if r[0] != 20]  # beyond what components are held to
    assert mined(spark, held, 10) == expected(held, 10) != []
    assert mined(spark, rows, 20) == mined(spark, held, 20)  # label 7 has no other row


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**19 - i), float(i * 7 + 1)] * 4, i % 2) for i in range(40)]
    assert mined(spark, rows, 10, low=90, high=100) == expected(rows, 10, low=90, high=100)


def test_empty_inputs_and_clashing_names(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, [1.0], 1)], 10) == [] == mined(spark, [(0, [1.0], 1)], 10)
    rows = some_rows(2, 60)
    frame = spark.createDataFrame(
        [(*r, 1, "x", 2) for r in rows], SCHEMA + ", row int, anchor string, score int"
    )
    found = mine_hard_negatives(whole_vectors(frame, 256), F.col("vec_id") % 12 == 0)
    assert sorted(tuple(r) for r in found.collect()) == expected(rows, 12)
