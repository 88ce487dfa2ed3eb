"""Token counts by overlap resynchronisation.

Texts of up to ``chunk_chars`` characters are encoded whole. A longer one is cut into
chunks that overlap their successor, and the chunks are encoded wherever there is room.
Two neighbours are spliced at a word boundary that both encodings have at the same
offset. Such a boundary is proven stable:

* the left chunk scanned up to it with all the text that any of its decisions can see
  (it lies ``margin`` characters before the chunk's end: longer than the special strings
  and than the pattern's look-ahead);
* a pattern scan has no memory, so from a common boundary on the right chunk makes the
  same matches as a scan of the whole text.

Where an overlap has no common boundary (a word longer than it), the text's chunks and
overlaps are doubled until it has, at last up to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.encoding import byte_level_cut, encoded_segments, load_tokenizer
from threadlens.session import cut_lineage

CHUNK_CHARS, OVERLAP_CHARS, MARGIN_CHARS = 32_768, 1_024, 16
CHUNKS_AT_ONCE = 32


def _count_whole(path: str, keys: list[str]):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load_tokenizer(path)
        for batch in batches:
            found = encoded_segments(
                tokenizer, batch["__text"], byte_level_cut, joint=" ", name=path
            )
            sizes = [sum(map(len, x)) // 4 for x in found]
            yield batch[[*keys, "n_bytes"]].assign(n_tokens=sizes)

    return count


def _boundaries(encoding, low: int, high: int) -> tuple[list[int], list[int]]:
    """Offsets in [low, high) where a word starts, and the tokens before each."""
    words, spans = encoding.word_ids, encoding.offsets
    at = [
        i for i in range(len(words))
        if (i == 0 or words[i] != words[i - 1]) and low <= spans[i][0] < high
    ]
    return [spans[i][0] for i in at], at


def _count_chunks(path: str, chunk: int, overlap: int, margin: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load_tokenizer(path)
        for batch in batches:
            rows = []
            for row, k, text in zip(batch["row"], batch["k"], batch["part"]):
                found = tokenizer.encode(text, add_special_tokens=False)
                lead = _boundaries(found, 0, overlap)
                # A chunk that sees the end of its text has nothing left to see.
                unseen = margin if len(text) == chunk + overlap else 0
                trail = _boundaries(found, chunk, len(text) - unseen)
                trail = ([p - chunk for p in trail[0]], trail[1])
                rows.append((row, k, len(found), *lead, *trail))
            yield pd.DataFrame(
                rows, columns=["row", "k", "n", "lead", "lead_n", "trail", "trail_n"]
            )

    return count


CHUNK_ROW = (
    "row long, k int, n long, lead array<int>, lead_n array<int>, "
    "trail array<int>, trail_n array<int>"
)


def _cut(chunk: int, overlap: int):
    """Each text once through a task, in slices."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                places = range(0, len(text), chunk)
                for at in range(0, len(places), CHUNKS_AT_ONCE):
                    some = places[at : at + CHUNKS_AT_ONCE]
                    yield pd.DataFrame(
                        {"row": row, "k": range(at, at + len(some)),
                         "part": [text[i : i + chunk + overlap] for i in some]}
                    )

    return cut


def _encoded_chunks(texts: DataFrame, path: str, chunk: int, overlap: int, margin: int):
    """One row per chunk: its number of tokens, and the word boundaries in the part it
    shares with the chunk before and after it (offsets within that part)."""
    parts = texts.select("row", "text").mapInPandas(
        _cut(chunk, overlap), "row long, k int, part string"
    )
    return parts.repartition("row", "k").mapInPandas(
        _count_chunks(path, chunk, overlap, margin), CHUNK_ROW
    )


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", keys: Sequence[str] = ("doc_id",),
    chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
    margin: int = MARGIN_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: ``keys``, ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``path`` names a byte-level BPE vocabulary for the ``tokenizers`` library, readable
    on every executor. No special tokens are added; special strings inside a text are
    tokens, as the library takes them by default. A null or empty text has 0 bytes and
    0 tokens. Keys may be null or repeat: rows are told apart by position."""
    if overlap * 2 > chunk_chars or margin >= overlap:
        raise ValueError("an overlap must fit twice into a chunk and exceed the margin")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *keys, F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("__text")
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = [*keys, "n_bytes", "n_tokens"]
    schema = ", ".join(f"`{c}` {kinds.get(c, 'bigint')}" for c in out)
    short = rows.where(F.char_length("__text") <= chunk_chars).mapInPandas(
        _count_whole(path, list(keys)), schema
    )
    long = cut_lineage(
        rows.where(F.char_length("__text") > chunk_chars)
        .withColumn("row", F.monotonically_increasing_id())
    )
    texts = long.select("row", F.col("__text").alias("text"))
    counted = _spliced(texts, path, chunk_chars, overlap, margin)
    return short.unionByName(
        long.join(counted.withColumnRenamed("row", "__row"), F.col("row") == F.col("__row"))
        .select(*out)
    )


def _spliced(texts: DataFrame, path: str, chunk: int, overlap: int, margin: int) -> DataFrame:
    """(row, n_tokens) of long texts."""
    done = None
    while True:
        chunks = cut_lineage(_encoded_chunks(texts, path, chunk, overlap, margin))
        left = chunks.select("row", "k", "n", "trail", "trail_n")
        right = chunks.where(F.col("k") > 0).select(
            F.col("row").alias("r"), (F.col("k") - 1).alias("before"), "lead", "lead_n"
        )
        same = (F.col("row") == F.col("r")) & (F.col("k") == F.col("before"))
        at = F.array_min(F.array_intersect("trail", "lead"))
        kept = F.element_at("trail_n", F.array_position("trail", F.col("at")).cast("int"))
        skipped = F.element_at("lead_n", F.array_position("lead", F.col("at")).cast("int"))
        joints = (
            left.join(right, same).withColumn("at", at)
            .select("row", F.when(F.col("at").isNotNull(), kept - F.col("n") - skipped).alias("n"))
        )
        sums = (
            chunks.select("row", "n").unionByName(joints)
            .groupBy("row")
            .agg(F.sum("n").alias("n_tokens"), F.bool_or(F.col("n").isNull()).alias("open"))
        )
        sums = cut_lineage(sums)
        spliced = sums.where(~F.col("open")).select("row", "n_tokens")
        done = spliced if done is None else done.unionByName(spliced)
        still = sums.where("open").select(F.col("row").alias("r"))
        if still.isEmpty():
            return done
        texts = texts.join(still, F.col("row") == F.col("r"), "left_semi")
        chunk, overlap = chunk * 2, overlap * 2
