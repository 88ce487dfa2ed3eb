"""Quality scores of documents: an additive model over simple text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.gam import AdditiveModel, fit
from threadlens.llm.labelled import labelled_rows

TRAINING_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words",
    "commonest_word", "log_lines", "distinct_lines", "letters", "upper", "digits",
    "blanks", "stops", "commas", "bars", "symbols", "not_ascii", "byte_entropy",
)


def _byte_class(chars: bytes) -> np.ndarray:
    return np.frombuffer(chars, np.uint8).astype(np.int64)


_LOWER, _UPPER = _byte_class(bytes(range(97, 123))), _byte_class(bytes(range(65, 91)))
_DIGIT, _BLANK = _byte_class(b"0123456789"), _byte_class(b" \t\n\x0b\x0c\r")
_STOP, _COMMA, _BAR = _byte_class(b".!?"), _byte_class(b",;:"), _byte_class(b"|")
_SYMBOL = _byte_class(b"#$%&*@^~<>{}[]\\/=+_`\"")


def text_features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``; all finite. A null
    text counts as empty, which has 0 everywhere."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    n, n_words = len(data), max(1, len(words))
    length = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    part = count[count > 0] / n
    share = [count[c].sum() / n for c in (_UPPER, _DIGIT, _BLANK)]
    per_word = [count[c].sum() / n_words for c in (_STOP, _COMMA, _BAR, _SYMBOL)]
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(length.mean()),
        float(length.std()), len(seen) / n_words, max(seen.values(), default=0) / n_words,
        float(np.log1p(len(lines))), len(set(lines)) / len(lines),
        float((count[_LOWER].sum() + count[128:].sum()) / n), *map(float, share),
        *map(float, per_word), float(count[128:].sum() / n), float(-(part * np.log2(part)).sum()),
    ]


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS
) -> AdditiveModel:
    """Fit on a sample of about ``rows`` labelled documents, at most twice as many; only
    their features come to the driver. Leave held-out labels out of ``labels``."""
    # Features are computed in the tasks, so that texts stay there.
    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [text_features(t) for t in batch["text"]]
            yield pd.DataFrame({"x": found, "label": batch["label"]})

    sample = labelled_rows(docs, labels, label, rows, by_class=False)
    got = sample.mapInPandas(featured, "x array<double>, label int").limit(2 * rows).collect()
    got.sort()  # rows arrive in any order; sums of floats depend on it
    x = np.array([r["x"] for r in got], dtype=float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["label"] for r in got], dtype=float))


def quality_score(model: AdditiveModel, text: Column | str) -> Column:
    """A score from 0 to 1 for each whole text; higher means label 1 is likelier."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([text_features(t) for t in texts], dtype=float)
            yield pd.Series(model.scores(x.reshape(len(texts), len(FEATURES))))

    return score(text)
