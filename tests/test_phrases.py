"""Phrases looked up a batch at a time, and the cleaning of spaces."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadlens.functions import phrases as ph
from threadlens.functions import rules as rl
from threadlens.functions import text as tx


@pytest.mark.parametrize("piece", [50, ph._PIECE])
def test_found_equals_plain_search(monkeypatch, piece):
    monkeypatch.setattr(ph, "_PIECE", piece)
    pick = random.Random(3)
    for _ in range(200):
        letters = pick.choice(["ab ", "abcé ", "αβ😀x"])

        def word(low, high):
            return "".join(pick.choice(letters) for _ in range(pick.randrange(low, high)))

        texts = [None if pick.random() < 0.1 else word(0, 30) for _ in range(pick.randrange(8))]
        groups = [[word(1, 6) for _ in range(pick.randrange(4))] for _ in range(pick.randrange(1, 4))]
        want = [None if t is None else [[p for p in g if p in t] for g in groups] for t in texts]
        assert ph.occurring(pa.array(texts, pa.string()), groups).to_pylist() == want


def test_a_text_is_read_once_for_all_phrases(spark):
    rules = {"first": ["alpha", "beta"], "second": ["gamma", "delta"]}
    df = spark.createDataFrame([("a beta and gamma, delta",), (None,)], "c string")
    out = df.select(
        rl.label_by_count(F.col("c"), rules, "none").alias("label"),
        rl.signals(F.col("c"), rules).alias("signals"),
        rl.contains_any(F.col("c"), ["eta"]).alias("hit"),
        rl.matches(F.col("c"), ["delta", "x", "beta"]).alias("matched"),
    )
    assert [tuple(r) for r in out.collect()] == [
        ("second", ["first", "second"], True, ["delta", "beta"]), ("none", [], None, []),
    ]
    assert "contains(" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_uneven_spaces_are_squashed_like_all_spaces(spark):
    pick = random.Random(5)
    rows = [("".join(pick.choice("aB1' \t\n\x1c\xa0é-_") for _ in range(12)),) for _ in range(300)]
    df = spark.createDataFrame(rows, "c string")

    def blank(pattern):
        return F.trim(F.regexp_replace("c", F.lit(pattern), F.lit(" ")))

    for even, uneven in ((tx.SPACES, tx.UNEVEN_SPACES), (tx.NOT_PLAIN, tx.UNEVEN_NOT_PLAIN)):
        assert df.where(blank(even) != blank(uneven)).count() == 0
