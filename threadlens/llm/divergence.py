"""How far sources differ: a divergence between term distributions, row by row.

The groups (lang, source) and the kept terms of a language are a sparse matrix of counts.
The divergence of two groups is a sum over all kept terms, so the matrix is multiplied
with itself, with a divergence in place of the product, in Gustavson's way: blocks of the
term-major index go to tasks; each group walks its own terms through the index and
scatters into one dense accumulator with a cell per peer. No pair of postings is ever
emitted, only one row per block, group and peer.

A count of zero still has a probability, its group's baseline. The accumulators start
from what two rows of baselines differ by; terms that one side has, or both, correct that.

Probabilities are whole billionths, so all sums are exact."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.session import cut_lineage

SCALE = 1_000_000_000
BLOCK_POSTINGS = 200_000  # about so many cells of the matrix are one task's index
SLAB_CELLS = 2_000_000  # cells of accumulators that a task gives at a time
FLUSH_TERMS = 300_000  # distinct terms that a counting task holds
SLICE_BYTES = 1 << 20
ROWS = 50_000

# A term is a run of letters A-Z, a-z and of characters beyond ASCII, which in UTF-8 are
# bytes from 0x80 on: texts can be cut as bytes.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_COUNTED = "lang string, source string, term binary, n long, docs long"


def _slices(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a megabyte at a time."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a task's groups, and per group one row
    without a term."""
    terms: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n, docs = terms.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            seen: set[bytes] = set()
            for words in _slices(text.translate(_LETTERS)):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            held += len(n) - before
            if held >= FLUSH_TERMS:
                yield from _counted(terms)
                terms, held = {}, 0
    yield from _counted(terms)


def _counted(terms: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in terms.items():
        names = [None, *n]
        for at in range(0, len(names), ROWS):
            part = names[at : at + ROWS]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(part), pa.string()),
                    pa.array([source] * len(part), pa.string()),
                    pa.array(part, pa.binary()),
                    pa.array([n[t] if t is not None else 0 for t in part], pa.int64()),
                    pa.array([docs[t] if t is not None else 0 for t in part], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def term_index(
    docs: DataFrame, min_docs: int, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """The term-major index (lang, term, postings: array of (source, n)) of the terms that
    ``min_docs`` documents of a language hold. The row of a language without a term lists
    all its sources. Null texts, languages and sources are ''.

    Tasks count before the one shuffle, by language and term: a term that every document
    holds costs a row per task and group."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        empty(lang).alias("lang"), empty(source).alias("source"),
        empty(text).cast("binary").alias("text"),
    )
    counted = rows.mapInArrow(_count_terms, _COUNTED).repartition("lang", "term")
    summed = counted.groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    return (
        summed.groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "n")).alias("postings"), F.sum("docs").alias("docs"))
        .where((F.col("docs") >= min_docs) | F.col("term").isNull())
        .select("lang", F.col("term").cast("string").alias("term"), "postings")
    )


def _share(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / whole), by long division in three digits of 1000: exact
    for totals up to 9e15."""
    rest, found = n + 2, 0
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // whole
        rest = rest % whole
    return 1 + found


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _accumulate(key: tuple, cells: pd.DataFrame, peers: pd.DataFrame) -> pd.DataFrame:
    """A block's share in the divergence of a slab of groups from all peers.

    ``cells`` is the block of the index (term, source, n); ``peers`` all groups of the
    language (source, total, kept), of which the slab's are the rows."""
    lang, block, slab, width = key
    peers = peers.sort_values("source", ignore_index=True)
    names = peers["source"].to_numpy()
    rows = np.arange(slab * width, min((slab + 1) * width, len(names)))
    kept = int(peers["kept"].iloc[0]) if len(peers) else 0
    found = np.zeros((len(rows), len(names)), np.int64)
    if kept:
        whole = peers["total"].to_numpy(np.int64) + 2 * kept
        zero = _share(np.zeros(len(names), np.int64), whole)
        term = pd.factorize(cells["term"])[0]
        peer = pd.Index(names).get_indexer(cells["source"])
        share = _share(cells["n"].to_numpy(np.int64), whole[peer])
        by_term = np.argsort(term, kind="stable")
        first = np.searchsorted(term[by_term], np.arange(len(term) + 1))
        index_peer, index_share = peer[by_term], share[by_term]
        by_peer = np.argsort(peer, kind="stable")
        start = np.searchsorted(peer[by_peer], np.arange(len(names) + 1))
        # What peers hold, each share once: only these meet a group's baseline.
        held, times = np.unique(np.stack([peer, share]), axis=1, return_counts=True)
        for g, sums in zip(rows, found):
            base = _apart(zero[g], zero)
            if block == 0:
                sums += kept * base
            np.add.at(sums, held[0], times * (_apart(zero[g], held[1]) - base[held[0]]))
            own = by_peer[start[g] : start[g + 1]]
            if not len(own):
                continue
            for s, n in zip(*np.unique(share[own], return_counts=True)):
                sums += n * (_apart(s, zero) - base)
            # The terms' postings one after the other, and the group's share beside each.
            at, many = first[term[own]], first[term[own] + 1] - first[term[own]]
            upto = np.cumsum(many)
            place = np.arange(upto[-1]) + np.repeat(at - upto + many, many)
            mine, other, q = np.repeat(share[own], many), index_peer[place], index_share[place]
            np.add.at(
                sums, other,
                _apart(mine, q) - _apart(mine, zero[other]) - _apart(zero[g], q) + base[other],
            )
    here = np.repeat(rows, len(names))
    there = np.tile(np.arange(len(names)), len(rows))
    other = here != there
    return pd.DataFrame(
        {"lang": lang, "source": names[here[other]], "item": names[there[other]],
         "value": found.ravel()[other]}
    )


def _exact_share(n: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / whole) in whole numbers."""
    return F.call_function(
        "div", (n + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), whole
    ) + 1


def source_divergence(
    docs: DataFrame, min_docs: int = 10, top_terms: int = 10, text: str = "text",
    lang: str = "lang", source: str = "source", block_postings: int = BLOCK_POSTINGS,
    slab_cells: int = SLAB_CELLS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of ``docs``.

    Terms are runs of letters and characters beyond ASCII, A-Z lower-cased; a language
    keeps those in ``min_docs`` of its documents, V of them. With ``count`` occurrences
    of a kept term and N of all, p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two
    shares differ by f = floor((p - q)^2 / (p + q)).

    Part ``pair``: the other sources of the language, f summed over all kept terms (0
    without any). Part ``term``: the ``top_terms`` terms that a group uses more than its
    language does, by f against the language's share. Largest value first, then the item
    in byte order. Null texts, languages and sources are ''; repeated rows count as often
    as they occur; no documents give no rows. A language's only source has no pairs."""
    index = cut_lineage(term_index(docs, min_docs, text, lang, source))
    terms = index.where(F.col("term").isNotNull())
    cells = terms.select("lang", "term", F.inline("postings"))
    groups = index.where(F.col("term").isNull()).select("lang", F.inline("postings")).drop("n")
    sizes = terms.groupBy(F.col("lang").alias("l")).agg(
        F.count("*").alias("kept"), F.sum(F.size("postings")).alias("cells"),
        F.sum(F.aggregate("postings", F.lit(0).cast("long"), lambda a, p: a + p["n"])).alias("all"),
    )
    peers_of = groups.groupBy(F.col("lang").alias("pl")).agg(F.count("*").alias("peers"))
    totals = cells.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(
        F.sum("n").alias("total")
    )
    stats = cut_lineage(
        groups.join(totals, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left")
        .drop("l", "s").join(sizes, F.col("lang") == F.col("l"), "left").drop("l")
        .join(peers_of, F.col("lang") == F.col("pl"))
        .select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("kept", F.lit(0)).alias("kept"), "all",
            F.greatest(F.ceil(F.col("cells") / block_postings), F.lit(1)).cast("int").alias("blocks"),
            F.greatest(F.floor(slab_cells / F.col("peers")), F.lit(1)).cast("int").alias("width"),
            "peers",
        )
    )
    pairs = _pairs(cells, stats)
    found = pairs.unionByName(_over_used(terms, stats, top_terms))
    return found.select("lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _pairs(cells: DataFrame, stats: DataFrame) -> DataFrame:
    # How a language is cut, one row each.
    cut = cut_lineage(
        stats.groupBy(F.col("lang").alias("l")).agg(
            F.max("blocks").alias("blocks"), F.max("width").alias("width"),
            F.ceil(F.max("peers") / F.max("width")).cast("int").alias("slabs"),
        )
    )
    slab = F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    dealt = cells.join(cut, F.col("lang") == F.col("l")).select(
        "lang", block, slab, "width", "term", "source", "n"
    )
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    peers = (
        stats.drop("blocks", "width").join(cut, F.col("lang") == F.col("l"))
        .select("lang", blocks, "slabs", "width", "source", "total", "kept")
        .select("lang", "block", slab, "width", "source", "total", "kept")
        .toDF("p_lang", "p_block", "p_slab", "p_width", "source", "total", "kept")
    )
    key = ("lang", "block", "slab", "width")
    own = peers.groupBy(*(f"p_{k}" for k in key))
    sums = dealt.groupBy(*key).cogroup(own).applyInPandas(
        _accumulate, "lang string, source string, item string, value long"
    )
    summed = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(summed.withColumn("part", F.lit("pair")))


def _over_used(terms: DataFrame, stats: DataFrame, top: int) -> DataFrame:
    whole = F.aggregate("postings", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    used = terms.select(
        F.col("lang").alias("ul"), F.col("term").alias("item"), whole.alias("every"),
        F.inline("postings").alias("us", "n"),
    )
    joined = used.join(stats, (F.col("ul") == F.col("lang")) & (F.col("us") == F.col("source")))
    shares = joined.where(F.col("n") > 0).select(
        "lang", "source", "item",
        _exact_share(F.col("n"), F.col("total") + 2 * F.col("kept")).alias("p"),
        _exact_share(F.col("every"), F.col("all") + 2 * F.col("kept")).alias("q"),
    )
    apart = (F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))
    value = F.call_function("div", apart, F.col("p") + F.col("q"))
    over = shares.where(F.col("p") > F.col("q")).select(
        "lang", "source", "item", value.alias("value"), F.lit("term").alias("part")
    )
    return _ranked(over).where(F.col("rank") <= top)
