"""Toxicity scores from subword-bag embeddings.

A word is the average of the vectors of its character n-grams (hashed to a fixed number
of rows) and of its own row; a window of words is the average of its words, and a linear
softmax over the window's vector gives its score. Vectors and softmax are trained
together. A misspelt or inflected word shares most n-grams with the known one, so it gets
a similar vector without ever having been seen.

A document is as toxic as its worst window. Training starts from all windows and goes on
with the window of each document that the model then finds worst.

Scoring a word needs only the product of its vector with the softmax: each distinct word
is looked up once per task, and a document's windows are sums over its words' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.gam import sigmoid
from threadlens.llm.labelled import labelled_rows
from threadlens.session import cut_lineage

TRAINING_ROWS, TRAINING_CHARS = 6_000, 12_000_000
BUCKETS, DIM, WINDOW = 1 << 16, 8, 8
SHORTEST, LONGEST = 3, 5
CACHED_WORDS = 300_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def subwords(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, counts): the hashed n-grams of each word with its ends marked, and the
    word's own row, one after the other."""
    rows, counts = [np.empty(0, np.int32)], []
    for at in range(0, len(words), 10_000):
        part: list[int] = []
        for w in words[at : at + 10_000]:
            marked = b"<" + w + b">"
            grams = [marked] + [
                marked[i : i + n]
                for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)
            ]
            part += [xxhash.xxh3_64_intdigest(g) % buckets for g in grams]
            counts.append(len(grams))
        rows.append(np.array(part, np.int32))
    return np.concatenate(rows), np.array(counts, np.int64)


@dataclass
class SubwordModel:
    """``weights[r]``: what row r adds to the margin of label 1, the vector of the row
    times the difference of the softmax rows; ``bias`` their difference of offsets."""

    weights: np.ndarray
    bias: float

    def word_margins(self, words: list[bytes]) -> np.ndarray:
        rows, counts = subwords(words, len(self.weights))
        if not len(counts):
            return np.empty(0)
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(self.weights[rows], starts) / counts

    def score(self, margins: np.ndarray) -> float:
        """The score of the worst window of words with these margins."""
        if not len(margins):
            return float(sigmoid(np.array([min(self.bias, -3.0)]))[0])
        width = min(WINDOW, len(margins))
        upto = np.concatenate([[0.0], np.cumsum(margins)])
        mean = (upto[width:] - upto[:-width]) / width
        return float(sigmoid(np.array([mean.max() + self.bias]))[0])


@dataclass
class _Corpus:
    """Training texts as word numbers, and each distinct word's rows."""

    word: np.ndarray  # of each position of all texts
    begin: np.ndarray  # of each text
    size: np.ndarray
    rows: np.ndarray
    counts: np.ndarray

    def word_means(self, values: np.ndarray) -> np.ndarray:
        starts = np.cumsum(self.counts) - self.counts
        return np.add.reduceat(values[self.rows], starts) / self.counts

    def to_rows(self, position: np.ndarray, share: np.ndarray, buckets: int) -> np.ndarray:
        """Carry shares of positions back to the rows of their words."""
        per_word = np.bincount(self.word[position], share, len(self.counts)) / self.counts
        return np.bincount(self.rows, np.repeat(per_word, self.counts), buckets)


def _corpus(docs: list[list[bytes]], buckets: int) -> _Corpus:
    vocabulary: dict[bytes, int] = {}
    word = np.array([vocabulary.setdefault(w, len(vocabulary)) for d in docs for w in d])
    size = np.array([len(d) for d in docs])
    rows, counts = subwords(list(vocabulary), buckets)
    return _Corpus(word, np.cumsum(size) - size, size, rows, counts)


def _all_windows(corpus: _Corpus, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, text) of windows side by side, at another offset each turn."""
    own = np.repeat(np.arange(len(corpus.size)), corpus.size)
    place = np.arange(len(corpus.word)) - np.repeat(corpus.begin, corpus.size)
    fits = place + WINDOW <= np.repeat(corpus.size, corpus.size)
    begin = np.flatnonzero((place == 0) | (fits & ((place + turn) % WINDOW == 0)))
    return begin, own[begin]


def _worst_windows(corpus: _Corpus, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, text) of the window of the highest mean of each text."""
    upto = np.concatenate([[0.0], np.cumsum(margins)])
    begin = []
    for at, n in zip(corpus.begin, corpus.size):
        width = min(WINDOW, n)
        mean = upto[at + width : at + n + 1] - upto[at : at + n + 1 - width]
        begin.append(at + int(mean.argmax()))
    return np.array(begin), np.arange(len(corpus.size))


def fit_subwords(
    texts: list[str | None], labels: np.ndarray, warm_up: int = 20, epochs: int = 60,
    rate: float = 1.5, buckets: int = BUCKETS, seed: int = 3,
) -> SubwordModel:
    """Train on whole texts. Without both labels the model gives a constant score.

    The first ``warm_up`` rounds learn from all windows of a text, the others from its
    worst one, which is the one that scoring looks at: in a clean text it must come out
    clean, in a toxic one toxic. Both labels weigh the same in sum."""
    labels = np.asarray(labels, float)
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    docs = [words_of(t) for t in texts]
    kept = np.array([bool(d) for d in docs], bool)
    target, docs = labels[kept], [d for d in docs if d]
    if len(target) == 0 or target.min() == target.max():
        return SubwordModel(np.zeros(buckets), float(np.log(share / (1 - share))))
    corpus = _corpus(docs, buckets)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (buckets, DIM)) / DIM
    softmax, offset = rng.uniform(-0.5, 0.5, DIM), 0.0
    sums = [np.zeros_like(vectors), np.zeros_like(softmax), 0.0]  # Adagrad's
    for turn in range(warm_up + epochs):
        # Everything below is linear in the rows, so the margins of rows suffice.
        margins = corpus.word_means(vectors @ softmax)[corpus.word]
        if turn < warm_up:
            begin, own = _all_windows(corpus, turn)
        else:
            begin, own = _worst_windows(corpus, margins)
        width = np.minimum(WINDOW, corpus.size[own])
        upto = np.concatenate([[0.0], np.cumsum(margins)])
        y = target[own]
        total = np.where(y == 1, (y == 1).sum(), (y == 0).sum())
        margin = (upto[begin + width] - upto[begin]) / width + offset
        error = (sigmoid(margin) - y) / total
        position = np.repeat(begin - np.cumsum(width) + width, width) + np.arange(width.sum())
        per_row = corpus.to_rows(position, np.repeat(error / width, width), buckets)
        steps = (per_row[:, None] * softmax, vectors.T @ per_row, float(error.sum()))
        sums = [s + g * g for s, g in zip(sums, steps)]
        vectors -= rate * steps[0] / (np.sqrt(sums[0]) + 1e-12)
        softmax = softmax - rate * steps[1] / (np.sqrt(sums[1]) + 1e-12)
        offset -= rate * steps[2] / (np.sqrt(sums[2]) + 1e-12)
    return _calibrated(SubwordModel(vectors @ softmax, float(offset)), docs, target)


def _calibrated(model: SubwordModel, docs: list, labels: np.ndarray) -> SubwordModel:
    """Rescale the margin, so that the worst windows of the training documents get scores
    that agree with their labels (a logistic fit of scale and offset)."""
    known: dict[bytes, float] = {}
    fresh = list(set().union(*map(set, docs)))
    known.update(zip(fresh, model.word_margins(fresh)))
    raw = []
    for d in docs:
        m = np.array([known[w] for w in d]) if d else np.empty(0)
        width = min(WINDOW, len(m))
        upto = np.concatenate([[0.0], np.cumsum(m)])
        raw.append(((upto[width:] - upto[:-width]) / width).max() if width else np.nan)
    raw = np.array(raw)
    x, y = raw[~np.isnan(raw)], labels[~np.isnan(raw)].astype(float)
    if len(x) == 0 or y.min() == y.max():
        return model
    center, spread = float(x.mean()), float(x.std() + 1e-9)
    z = (x - center) / spread
    design = np.column_stack([z, np.ones_like(z)])
    beta = np.zeros(2)
    for _ in range(50):  # Newton with a little ridge, which keeps it finite
        p = sigmoid(design @ beta)
        slope = design.T @ (y - p) - 1e-3 * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(curve, slope), -2, 2)
    scale = max(float(beta[0]), 0.0) / spread
    return SubwordModel(model.weights * scale, float(beta[1] - scale * center))


def within_budget(texts: list[tuple[int, int, int]], chars: int) -> list[tuple[int, int]]:
    """Hash and label of the texts, from (hash, label, size) in order, that fit: each class
    into its half of ``chars``, then the others into what is left."""
    left, taken = {0: chars // 2, 1: chars // 2}, set()
    for h, label, size in texts:
        if size <= left[label]:
            left[label] -= size
            taken.add((h, label))
    rest = chars - 2 * (chars // 2) + sum(left.values())
    for h, label, size in texts:
        if (h, label) not in taken and size <= rest:
            rest -= size
            taken.add((h, label))
    return sorted(taken)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS,
    chars: int = TRAINING_CHARS, **options,
) -> SubwordModel:
    """Fit on about ``rows`` labelled documents (never over twice as many), half of each
    class where there are enough, equal texts once, taken in hash order up to ``chars``
    characters. Half of them are for each class, what is left for the rest; a document that
    does not fit is passed over. Leave held-out labels out of ``labels``."""
    sample = labelled_rows(docs, labels, label, rows, by_class=True)
    size = F.coalesce(F.char_length("text"), F.lit(0))
    ordered = cut_lineage(
        sample.withColumn("size", size).where(F.col("size") <= chars)
        .withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "label"])
    )
    keys = ordered.select("h", "label", "size").orderBy("h", "label").limit(2 * rows).collect()
    taken = within_budget([tuple(r) for r in keys], chars)
    if not taken:
        return fit_subwords([], np.empty(0), **options)
    chosen = docs.sparkSession.createDataFrame(taken, "h long, label int")
    kept = ordered.join(F.broadcast(chosen), ["h", "label"], "left_semi")
    got = sorted((r["h"], r["label"], r["text"]) for r in kept.collect())
    return fit_subwords([t for *_, t in got], np.array([m for _, m, _ in got]), **options)


def toxicity_score(model: SubwordModel, text: Column | str) -> Column:
    """A score from 0 to 1 for each whole text; higher means label 1 is likelier. A null,
    empty or blank text has no window and gets a low score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[bytes, float] = {}
        for texts in batches:
            out = []
            for at in range(0, len(texts), 64):
                docs = [words_of(t) for t in texts.iloc[at : at + 64]]
                if len(known) > CACHED_WORDS:
                    known = {}
                fresh = list(set().union(*docs) - known.keys())
                known.update(zip(fresh, model.word_margins(fresh)))
                out += [
                    model.score(np.fromiter((known[w] for w in d), float, len(d))) for d in docs
                ]
            yield pd.Series(out, dtype="float64")

    return score(text)
