"""Acceptance on published result files, found by their header.

GOLDEN_DIR names a folder with candidate CSV files (message, context and response
with their labels) and confusion-matrix CSV files beside a JSON of metrics."""

import csv
import json
import os
from pathlib import Path

import pytest

from threadlens.functions import lexicons as lx
from threadlens.operators import evaluation, frequency, labelling
from threadlens.sources import readers

ROOT = os.environ.get("GOLDEN_DIR")
if not ROOT or not os.path.isdir(ROOT):
    pytest.skip("GOLDEN_DIR not set", allow_module_level=True)

CANDIDATE = [
    "customer_tweet_id", "customer_author_id", "brand_tweet_id", "current_customer_message",
    "conversation_context", "historical_brand_response", "candidate_intent",
    "candidate_action", "escalation_signals", "context_turn_count", "ambiguity_score",
]


def files(header):
    for path in sorted(Path(ROOT).rglob("*.csv")):
        with open(path, encoding="utf-8") as f:
            if next(csv.reader(f), None) == header:
                yield path


def test_v1_rules_reproduce_every_candidate(spark):
    seen = 0
    for path in files(CANDIDATE):
        given = readers.read_csv_strings(spark, str(path), CANDIDATE)
        plain = given.select(*CANDIDATE[:6])
        got = labelling.label_v1(plain).collect()
        want = {r.brand_tweet_id: r for r in given.collect()}
        for r in got:
            w = want[r.brand_tweet_id]
            assert r.candidate_intent == w.candidate_intent
            assert r.candidate_action == w.candidate_action
            assert r.escalation_signals == (w.escalation_signals or "")
            assert r.ambiguity_score == int(w.ambiguity_score)
        seen += len(got)
    assert seen > 0


def test_metrics_from_confusion_matrices(spark):
    found = 0
    for path in files(["", *lx.INTENT_LABELS]):
        with open(path, encoding="utf-8") as f:
            rows = list(csv.reader(f))[1:]
        cells = [
            (r[0], label) for r in rows for label, n in zip(lx.INTENT_LABELS, r[1:])
            for _ in range(int(n))
        ]
        df = spark.createDataFrame(cells, "g string, p string")
        stem = path.name.replace("_confusion_matrix.csv", "")
        metrics = json.loads((path.parent / f"{stem}_results.json").read_text())["metrics"]
        acc = evaluation.accuracy(df, "g", "p").first()[0]
        f1 = evaluation.f1_summary(df, "g", "p").first()
        assert acc == pytest.approx(metrics["accuracy"], abs=1e-6)
        assert f1.macro_f1 == pytest.approx(metrics["macro_f1"], abs=1e-6)
        assert f1.weighted_f1 == pytest.approx(metrics["weighted_f1"], abs=1e-6)
        found += 1
    assert found > 0


@pytest.mark.parametrize("label", ["candidate_intent", "historical_action"])
def test_percentages(spark, label):
    for path in files([label, "count", "percentage"]):
        given = [(r[0], int(r[1]), float(r[2])) for r in list(csv.reader(open(path)))[1:]]
        df = spark.createDataFrame([(a, b) for a, b, _ in given], f"{label} string, n long")
        rows = df.selectExpr(label, "explode(sequence(1, n)) as i")
        got = {r[0]: r.percentage for r in frequency.frequency(rows, label).collect()}
        assert got == {a: p for a, _, p in given}
