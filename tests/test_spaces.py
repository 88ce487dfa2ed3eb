"""Cleaning by batches is as the patterns say; a message is cleaned and read once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadlens.functions import spaces, text as tx
from threadlens.operators import labelling

TEXTS = [
    "", " ", "a", " a ", "a  b", " a　 b\u0085", "é ", "日本 語", "it's  _ok_", "\n\n",
    "a\x1cb\x0bc", "​ a ﻿", "rt RT x", "a\t", "😀 b😀", "' '", "  x", " ", "Â a", "à",
]


def _by_pattern(c, pattern):
    return F.trim(F.regexp_replace(c, F.lit(pattern), F.lit(" ")))


def test_every_character_is_judged_as_by_the_pattern(spark):
    points = [(f"a{chr(i)}b",) for i in range(0x3100) if i]
    df = spark.createDataFrame([*points, *((t,) for t in TEXTS), ("\U00010400b",)], "c string")
    wrong = df.where(
        (spaces.squashed(F.col("c")) != _by_pattern(F.col("c"), tx.SPACES))
        | (spaces.plain(F.col("c")) != _by_pattern(F.col("c"), tx.NOT_PLAIN))
    )
    assert wrong.collect() == []


def test_batches_with_nulls_slices_and_nothing():
    blank = spaces._blank_spaces
    texts = pa.array([None, " a  b ", "", None, "c\n"])
    assert spaces.single_spaced(texts, blank).to_pylist() == [None, "a b", "", None, "c"]
    assert spaces.single_spaced(texts.slice(1, 2), blank).to_pylist() == ["a b", ""]
    assert spaces.single_spaced(texts.slice(0, 0), blank).to_pylist() == []
    assert spaces.single_spaced(pa.array([""]), blank).to_pylist() == [""]


MESSAGES = [
    "refund my broken order", "still not working rt", "Σ order Σ", "please call", "agent", "", " ",
    "x http://a.b/c", "@me my card", "order #1 cancel", "cancel", "my order " + "word " * 40 + "speak to",
]
BEFORE = ["", "Customer: ", "brand: sorry, contact us\nCustomer: ", "Customer: cancel\n", "not ", "no"]


@pytest.mark.parametrize("label", [
    labelling.label_analysis, labelling.label_v1, labelling.label_v2
])
def test_a_context_that_ends_with_the_message_is_labelled_as_if_read_whole(spark, label):
    rows = [(f"{i}-{j}", m, b + m, "ok") for i, m in enumerate(MESSAGES) for j, b in enumerate(BEFORE)]
    names = "id string, current_customer_message string, conversation_context string, " \
        "historical_brand_response string"
    df = spark.createDataFrame(rows, names)
    # A last space is cleaned away, and hides that the context ends with the message.
    hidden = df.withColumn("conversation_context", F.concat("conversation_context", F.lit(" ")))
    plan = label(df)
    drop = ["conversation_context"]
    a = {r.id: r for r in plan.drop(*drop).collect()}
    b = {r.id: r for r in label(hidden).drop(*drop).collect()}
    assert a == b
