"""TF-IDF in long form: one (id, term, weight) row per distinct term of a text.

weight = (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), then each text is scaled to
length 1. Texts are shuffled once by id and stay one row each: a batch of texts is counted
and weighted at a time, and (id, term) rows are never shuffled for a capped vocabulary.
Document frequencies are added up a batch of texts at a time before their shuffle, so that
no task holds the terms of all its texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.functions import lexicons as lx
from threadlens.functions import text as tx
from threadlens.operators.sizing import BROADCAST_ROWS, HOT_ROWS, broadcast_bounded, salted_join
from threadlens.session import cut_lineage


_WORDS = 500_000  # words of the texts counted at a time
_COMBINED_WORDS = 1_000_000  # the same where only sums over the texts are kept


@dataclass(frozen=True)
class TermSettings:
    """Which terms count. ``min_df`` is a number of texts, ``max_df`` a share."""

    min_df: int = 1
    max_df: float = 1.0
    max_features: int | None = None
    stop_words: tuple[str, ...] = ()
    accents: bool = True  # False strips them first


# The settings of each model of this package
BASELINE = TermSettings(min_df=2, max_df=0.95, max_features=100_000, accents=False)
FINAL = TermSettings(min_df=2, max_df=0.95, max_features=100_000)
DEMO = TermSettings()


def topic_settings(k_means: bool = False) -> TermSettings:
    """Settings of the common-term ranking, or of the K-means features."""
    if k_means:
        return TermSettings(10, 0.90, 15_000, tuple(lx.ENGLISH_STOP_WORDS))
    return TermSettings(20, 0.80, 5_000, tuple(lx.ENGLISH_STOP_WORDS))


def _words(text: Column | str, settings: TermSettings) -> Column:
    c = tx.text_or_empty(text)
    if not settings.accents:
        c = tx.strip_accents(F.lower(c))
    return tx.tokens(c)


def ngrams(text: Column | str, settings: TermSettings = DEMO) -> Column:
    """Terms of a text: tokens, stop words dropped, then pairs of neighbours."""
    toks = _words(text, settings)
    if settings.stop_words:
        toks = F.filter(toks, lambda t: ~t.isin(list(settings.stop_words)))
    return tx.with_bigrams(toks)


def packed_counts(
    docs: DataFrame, key: str, text: str, settings: TermSettings = DEMO,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(key, *carry, terms, tfs): the distinct terms of a text and how often each occurs.
    Rows of one key and carry are counted as one text. The text is shuffled once."""
    names = [key, *carry]
    words = _spread_words(docs, key, text, settings, carry)
    lists = [T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.LongType()))]
    schema = T.StructType([*(words.schema[c] for c in names), *lists])
    return words.mapInArrow(_by_text(names, settings.stop_words, _counted), schema)


def _spread_words(
    docs: DataFrame, key: str, text: str, settings: TermSettings, carry: Sequence[str]
) -> DataFrame:
    """(key, *carry, __words), rows of one text next to each other."""
    names = [key, *carry]
    spread = docs.select(*names, F.col(text).alias("__text")).repartition(key)
    return spread.sortWithinPartitions(*names).select(
        *names, _words("__text", settings).alias("__words")
    )


def _by_text(names: Sequence[str], stop_words: Sequence[str], finish, size: int = _WORDS):
    """Applies ``finish`` to the cells of some texts at a time of a partition, which is sorted
    by ``names``. The last text of a batch waits for the next one, as further rows of it may
    follow."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in _slices(batch, size):
                part = pa.Table.from_batches([part])
                held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
                text = _numbered(held, names)
                last = int(np.searchsorted(text, text[-1]))
                if last:
                    yield finish(held.slice(0, last), names, _cells(held.slice(0, last), text[:last], stop_words))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield finish(held, names, _cells(held, _numbered(held, names), stop_words))

    return count


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``size`` words."""
    length = pc.fill_null(pc.list_value_length(batch.column("__words")), 0)
    piece = np.cumsum(length.to_numpy(zero_copy_only=False)) // size
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def _numbered(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
    """The number of each row's text: equal neighbours are one text."""
    new = np.zeros(max(rows.num_rows - 1, 0), bool)
    for name in names:
        column = rows[name].combine_chunks()
        one, other = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        differ = pc.fill_null(pc.not_equal(one, other), False).to_numpy(zero_copy_only=False)
        nulls = pc.xor(one.is_null(), other.is_null()).to_numpy(zero_copy_only=False)
        new |= differ | nulls
    return np.concatenate([[0], np.cumsum(new)])[: rows.num_rows]


@dataclass(frozen=True)
class _Cells:
    """The distinct terms of some texts, by text: ``owner`` is the number of the text, ``first``
    and ``second`` the places of a term's words in ``known`` (-1: a single word)."""

    known: pa.Array
    text: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    second: np.ndarray
    tf: np.ndarray

    @property
    def texts(self) -> int:
        return int(self.text[-1]) + 1

    def keys(self, rows: pa.Table, names: Sequence[str]) -> pa.Table:
        """The key columns of every text."""
        first_rows = np.searchsorted(self.text, np.arange(self.texts))
        return rows.select(list(names)).take(pa.array(first_rows))


def _cells(rows: pa.Table, text: np.ndarray, stop_words: Sequence[str]) -> _Cells:
    words = rows["__words"].combine_chunks()
    length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(words).dictionary_encode()
    known, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    if stop_words:
        stopped = pc.is_in(known, pa.array(list(stop_words), known.type)).to_numpy(zero_copy_only=False)
        row, code = row[~stopped[code]], code[~stopped[code]]
    n = max(len(known), 1)
    if (int(text[-1]) + 1) * (n + 1) * n > 2**62:
        raise OverflowError("too many different words in a batch of texts")
    # A term is its text, its first word and 0 or 1 + its second word, as one number.
    same = row[1:] == row[:-1]
    first = text[row] * n + code
    cells = np.concatenate([first * (n + 1), (first[:-1] * (n + 1) + code[1:] + 1)[same]])
    cells, tf = np.unique(cells, return_counts=True)
    first, second = np.divmod(cells, n + 1)
    owner, first = np.divmod(first, n)
    return _Cells(known, text, owner, first, second - 1, tf.astype(np.int64))


def _terms(known: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.Array:
    """Terms as strings: a word, or two with a space between."""
    pair = second >= 0
    single, pairs = known.take(pa.array(first)), np.flatnonzero(pair)
    both = pc.binary_join_element_wise(
        single.take(pa.array(pairs)), known.take(pa.array(second[pairs])), pa.scalar(" ", known.type)
    )
    return pc.replace_with_mask(single, pa.array(pair), both).cast(pa.string())


def _counted(rows: pa.Table, names: Sequence[str], cells: _Cells) -> pa.RecordBatch:
    """A row per text: its terms and how often each occurs."""
    starts = np.searchsorted(cells.owner, np.arange(cells.texts + 1)).astype(np.int32)
    keys = cells.keys(rows, names)
    terms = _terms(cells.known, cells.first, cells.second)
    return pa.RecordBatch.from_arrays(
        [
            *(keys[c].combine_chunks() for c in names),
            pa.ListArray.from_arrays(pa.array(starts), terms),
            pa.ListArray.from_arrays(pa.array(starts), pa.array(cells.tf)),
        ],
        [*names, "terms", "tfs"],
    )


def _combined(rows: pa.Table, names: Sequence[str], cells: _Cells) -> pa.RecordBatch:
    """A row per term: the number of texts that hold it and its occurrences."""
    n = len(cells.known) + 1
    number = cells.first * n + cells.second + 1
    term, tf = np.unique(np.repeat(number, cells.tf), return_counts=True)
    df = np.unique(number, return_counts=True)[1]
    first, second = np.divmod(term, n)
    return pa.RecordBatch.from_arrays(
        [
            _terms(cells.known, first, second - 1),
            pa.array(df.astype(np.int64)), pa.array(tf.astype(np.int64)),
        ],
        ["term", "df", "tf"],
    )


def long_counts(packed: DataFrame, key: str, carry: Sequence[str] = ()) -> DataFrame:
    """(key, *carry, term, tf) from packed counts."""
    cells = F.explode(F.arrays_zip("terms", "tfs")).alias("c")
    return packed.select(key, *carry, cells).select(
        key, *carry, F.col("c.terms").alias("term"), F.col("c.tfs").alias("tf")
    )


def term_counts(
    docs: DataFrame, key: str, text: str, settings: TermSettings = DEMO,
    carry: Sequence[str] = (), combined: bool = False,
) -> DataFrame:
    """(key, *carry, term, tf). ``combined`` gives (term, df, tf) instead, added up over some
    texts at a time, a term in as many rows as there are such batches: all that
    ``vocabulary`` needs."""
    if combined:
        words = _spread_words(docs, key, text, settings, carry)
        count = _by_text([key, *carry], settings.stop_words, _combined, _COMBINED_WORDS)
        return words.mapInArrow(count, "term string, df long, tf long")
    return long_counts(packed_counts(docs, key, text, settings, carry), key, carry)


def vocabulary(counts: DataFrame, n_docs: Column, settings: TermSettings = DEMO) -> DataFrame:
    """(term, df, total_tf): terms within the document-frequency limits, at most
    ``max_features`` of them by total count, ties by term. ``counts`` has a row per text and
    term, or is combined."""
    df = F.count("*")
    if set(counts.columns) == {"term", "df", "tf"}:
        # Combined already: adding up again before the shuffle would hold a task's terms.
        counts, df = counts.repartition("term"), F.coalesce(F.sum("df"), F.lit(0))
    vocab = counts.groupBy("term").agg(df.alias("df"), F.sum("tf").alias("total_tf"))
    if settings.min_df > 1:
        vocab = vocab.where(F.col("df") >= settings.min_df)
    if settings.max_df < 1.0:
        vocab = vocab.where(F.col("df") <= F.lit(settings.max_df) * n_docs)
    if settings.max_features is not None:
        vocab = vocab.orderBy(F.desc("total_tf"), "term").limit(settings.max_features)
    return vocab


def idf(df: Column, n_docs: Column) -> Column:
    return F.log((n_docs + F.lit(1e0)) / (df + F.lit(1e0))) + F.lit(1e0)


def weights(
    counts: DataFrame, term_idf: DataFrame, key: str, bound: int | None,
    carry: Sequence[str] = (), hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(key, term, weight) of unit length from (key, term, tf) and (term, idf).

    A vocabulary capped below the broadcast limit is broadcast, which keeps the
    partitioning by key. An uncapped one is joined with common terms salted."""
    if bound is not None:
        joined = counts.join(broadcast_bounded(term_idf, bound), "term")
    else:
        joined = salted_join(
            counts, term_idf.withColumnRenamed("term", "__term"), "term", "__term",
            row_id=[key], how="inner", hot_rows=hot_rows,
        ).drop("__term")
    raw = joined.select(
        key, *carry, "term",
        ((F.lit(1e0) + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("raw"),
    )
    # The terms of one text are gathered to scale them: bounded by the text itself.
    gathered = raw.groupBy(key, *carry).agg(
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("len"),
        F.collect_list(F.struct("term", "raw")).alias("terms"),
    )
    return gathered.select(key, *carry, "len", F.explode("terms").alias("t")).select(
        key, *carry, F.col("t.term").alias("term"), (F.col("t.raw") / F.col("len")).alias("weight")
    )


class _Vocabulary:
    """A capped vocabulary as numbers: every term's words as places in ``words``."""

    def __init__(self, term: pa.Array, idf_of: np.ndarray):
        self.term, self.idf = term, idf_of
        parts = pc.split_pattern(term, " ")  # words hold no spaces
        length = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(parts).dictionary_encode()
        self.words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(length) - length
        second = np.full(len(length), -1)
        second[length == 2] = code[starts[length == 2] + 1]
        number = self._number(code[starts], second)
        self.order = np.argsort(number)
        self.number = number[self.order]

    def _number(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return first * (len(self.words) + 1) + second + 1

    def places(self, cells: _Cells) -> np.ndarray:
        """The place of every cell's term in ``term``, -1 for others."""
        own = pc.fill_null(pc.index_in(cells.known, self.words.cast(cells.known.type)), -1)
        own = np.append(own.to_numpy(zero_copy_only=False).astype(np.int64), -1)
        first, second = own[cells.first], own[cells.second]
        place = np.full(len(first), -1)
        known = np.flatnonzero((first >= 0) & ((second >= 0) | (cells.second < 0)))
        if len(known) and len(self.number):
            number = self._number(first[known], second[known])
            at = np.minimum(np.searchsorted(self.number, number), len(self.number) - 1)
            hit = self.number[at] == number
            place[known[hit]] = self.order[at[hit]]
        return place


def _shared_vocabulary(spark, term_idf: DataFrame):
    """A capped vocabulary in term order, for every task."""
    vocab = term_idf.select("term", "idf").toArrow().combine_chunks()  # at most BROADCAST_ROWS
    vocab = vocab.sort_by("term") if vocab.num_rows else vocab
    terms = vocab["term"].combine_chunks() if vocab.num_rows else pa.array([], pa.string())
    return spark.sparkContext.broadcast(_Vocabulary(terms, vocab["idf"].to_numpy().astype(np.float64)))


def _weigh(known: _Vocabulary, cells: _Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and text of the cells with known terms, their weights before and the length for
    scaling, one per text."""
    place = known.places(cells)
    held = np.flatnonzero(place >= 0)
    place, row = place[held], cells.owner[held]
    raw = (1 + np.log(cells.tf[held].astype(np.float64))) * known.idf[place]
    return place, row, raw, np.sqrt(np.bincount(row, raw * raw, cells.texts))


def _text_weights(
    docs: DataFrame, term_idf: DataFrame, key: str, text: str, settings: TermSettings,
    carry: Sequence[str],
) -> DataFrame:
    """``weights`` of texts for a capped vocabulary, which every task gets whole: a batch of
    texts at a time is counted and weighed, without a join or a shuffle of terms."""
    names = [key, *carry]
    words = _spread_words(docs, key, text, settings, carry)
    shared = _shared_vocabulary(docs.sparkSession, term_idf)

    def weigh(rows: pa.Table, names: Sequence[str], cells: _Cells) -> pa.RecordBatch:
        place, row, raw, size = _weigh(shared.value, cells)
        keys = cells.keys(rows, names)
        return pa.RecordBatch.from_arrays(
            [
                *(keys[c].combine_chunks().take(pa.array(row)) for c in names),
                shared.value.term.take(pa.array(place)), pa.array(raw / size[row]),
            ],
            [*names, "term", "weight"],
        )

    kinds = [words.schema[c] for c in names]
    cells = [T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]
    return words.mapInArrow(
        _by_text(names, settings.stop_words, weigh), T.StructType([*kinds, *cells])
    )


# How packed weights are stored: a dictionary for the few different ``raws``, small files.
PACKED = {"parquet.dictionary.page.size": str(8 << 20), "maxRecordsPerFile": "4096"}


def packed_weights(fitted: TfIdf, docs: DataFrame, key: str, text: str, by_row: bool = False) -> DataFrame:
    """(key, places, raws, length) of texts for a capped vocabulary, a row per text with known
    terms: sorted places in term order and weights before they are scaled by ``length``.
    ``raws`` repeat from text to text, so that a table of them is far smaller than one of
    weights (store it with ``PACKED``). ``by_row`` gives a row per row of ``docs`` instead,
    with the terms of its text, none for a row without a key."""
    words = _spread_words(docs, key, text, fitted.settings, [])
    shared = _shared_vocabulary(docs.sparkSession, fitted.terms)

    def pack(rows: pa.Table, names: Sequence[str], cells: _Cells) -> pa.RecordBatch:
        place, row, raw, size = _weigh(shared.value, cells)
        order = np.lexsort((place, row))
        n = np.bincount(row, minlength=cells.texts)
        lists = [
            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(x[order]))
            for x in (place.astype(np.int32), raw)
        ]
        if by_row:
            keys, wanted = rows.select(list(names)), cells.text
        else:
            wanted = np.flatnonzero(n)
            keys = cells.keys(rows, names).take(pa.array(wanted))
        own = keys[names[0]].combine_chunks()
        wanted = pa.array(wanted)
        if by_row:
            lists = [
                pc.if_else(own.is_valid(), x.take(wanted), pa.scalar([], x.type)) for x in lists
            ]
        else:
            lists = [x.take(wanted) for x in lists]
        return pa.RecordBatch.from_arrays([own, *lists, pa.array(size).take(wanted)], [*names, "places", "raws", "length"])

    kinds = [
        words.schema[key], T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("raws", T.ArrayType(T.DoubleType())), T.StructField("length", T.DoubleType()),
    ]
    return words.mapInArrow(_by_text([key], fitted.settings.stop_words, pack), T.StructType(kinds))


def scaled(raws: str = "raws", length: str = "length") -> Column:
    """Weights of unit length from those of ``packed_weights``."""
    return F.transform(raws, lambda x: x / F.col(length))


def _weighted(
    docs: DataFrame, term_idf: DataFrame, key: str, text: str, settings: TermSettings,
    carry: Sequence[str] = (),
) -> DataFrame:
    bound = settings.max_features
    if bound is not None and bound <= BROADCAST_ROWS:
        return _text_weights(docs, term_idf, key, text, settings, carry)
    counts = term_counts(docs, key, text, settings, carry)
    return weights(counts, term_idf, key, bound, carry)


@dataclass(frozen=True)
class TfIdf:
    """A fitted vocabulary: ``terms`` is (term, idf)."""

    terms: DataFrame
    settings: TermSettings

    def stored(self) -> TfIdf:
        """The same with its vocabulary written to the shared folder, so that several
        ``transform`` calls do not count the corpus again."""
        return TfIdf(cut_lineage(self.terms), self.settings)

    @property
    def capped(self) -> bool:
        """Whether every task may hold the vocabulary, as ``packed_weights`` needs."""
        cap = self.settings.max_features
        return cap is not None and cap <= BROADCAST_ROWS

    def transform(self, docs: DataFrame, key: str, text: str, carry: Sequence[str] = ()) -> DataFrame:
        return _weighted(docs, self.terms, key, text, self.settings, carry)


def fit_tfidf(docs: DataFrame, key: str, text: str, settings: TermSettings = DEMO) -> TfIdf:
    n_docs = docs.agg(F.count("*").cast("double")).scalar()
    vocab = vocabulary(term_counts(docs, key, text, settings, combined=True), n_docs, settings)
    return TfIdf(vocab.select("term", idf(F.col("df"), n_docs).alias("idf")), settings)


def fit_transform(
    docs: DataFrame, key: str, text: str, settings: TermSettings = DEMO
) -> tuple[TfIdf, DataFrame]:
    """A fitted vocabulary, stored, and the weights of the texts it was fitted on. With a
    capped vocabulary texts are cut into terms again, which costs less than to store all
    terms of all texts; without one they are stored."""
    if settings.max_features is not None:
        fitted = fit_tfidf(docs, key, text, settings).stored()
        return fitted, fitted.transform(docs, key, text)
    counts = cut_lineage(packed_counts(docs, key, text, settings))
    n_docs = docs.agg(F.count("*").cast("double")).scalar()
    vocab = vocabulary(long_counts(counts, key), n_docs, settings)
    fitted = TfIdf(vocab.select("term", idf(F.col("df"), n_docs).alias("idf")), settings).stored()
    return fitted, weights(long_counts(counts, key), fitted.terms, key, None)


def tfidf(docs: DataFrame, key: str, text: str, settings: TermSettings = DEMO) -> DataFrame:
    """(key, term, weight) of every text over the vocabulary of all of them."""
    return fit_tfidf(docs, key, text, settings).transform(docs, key, text)


def top_terms(docs: DataFrame, key: str, text: str, n: int = 100,
              settings: TermSettings | None = None) -> DataFrame:
    """Terms by mean weight over all texts."""
    settings = settings or topic_settings()
    n_docs = docs.agg(F.count("*").cast("double")).scalar()
    ranked = tfidf(docs, key, text, settings).groupBy("term").agg(F.sum("weight").alias("w"))
    return (
        ranked.select("term", F.round(F.col("w") / n_docs, 6).alias("mean_weight"))
        .orderBy(F.desc("mean_weight"), "term")
        .limit(n)
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, count, weight = n / (classes x count))."""
    counts = df.groupBy(label).agg(F.count("*").alias("count"))
    n = counts.agg(F.sum("count")).scalar()
    k = counts.agg(F.count("*")).scalar()
    return counts.withColumn("weight", n / (k * F.col("count")))
