"""Token counts and packing against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadlens.llm import token_counts
from threadlens.llm.packing import best_fit, pack_pieces, token_pieces

BYTE_BPE, WORD_BPE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "é", "ß", "’s", "'s", "'re", " ", "  ", "\n", "\t", " ", "　", "1", "23",
         "!?", "日本", "x" * 40, "\x1c", "\x85", "é", "́", "<|endoftext|>", "<|endof", "Σς"]


def odd_texts(n=60, seed=4):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 700))) for _ in range(n)]
    return [None, "", " ", "a", "z" * 3000, " " * 2500 + "q", "ab " * 2000, *made]


def test_counts_equal_whole_encoding(spark, monkeypatch):
    texts = odd_texts()
    whole = Tokenizer.from_file(BYTE_BPE)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rounds = []
    encode = token_counts._encoded_chunks
    monkeypatch.setattr(token_counts, "_encoded_chunks", lambda *a: rounds.append(a[2]) or encode(*a))
    for chunk, overlap in ((200, 60), (32_768, 1_024)):
        found = token_counts.count_tokens(docs, BYTE_BPE, chunk_chars=chunk, overlap=overlap)
        for r in found.collect():
            text = texts[r.doc_id] or ""
            assert r.n_tokens == len(whole.encode(text, add_special_tokens=False).ids), r.doc_id
            assert r.n_bytes == len(text.encode())
    # A word of 3,000 letters has no boundary within 60 characters: the overlap grew.
    assert rounds[:3] == [200, 400, 800] and max(rounds[:-1]) >= 1600


def test_counts_repeated_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    rows = token_counts.count_tokens(docs.withColumn("row", F.lit(0)), BYTE_BPE).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (0, 2), (3, 0)]
    assert token_counts.count_tokens(docs.limit(0), BYTE_BPE).count() == 0


def check_packing(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces_are_the_library_s_ids(spark):
    texts = odd_texts(30)
    whole = Tokenizer.from_file(WORD_BPE)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = token_pieces(docs, WORD_BPE, capacity=64, with_ids=True)
    rows = pack_pieces(pieces, 64).collect()
    assert check_packing(rows, 64) >= 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc_id, text in enumerate(texts):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [i for r in own for i in r.ids] == ids
        assert [r.start for r in own] == list(range(0, len(ids), 64))
        for r in own:
            assert r.length == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_as_few_bins_as_best_fit_decreasing(spark):
    rng = random.Random(1)
    for lengths in (
        [rng.randint(1, 99) for _ in range(900)],
        [7] * 400 + [60] * 150 + [41] * 100,  # a length that holds most of the rows
        [1] * 500,
    ):
        items = spark.createDataFrame(list(enumerate(lengths)), "item long, len long")
        spread = items.repartition(9)
        rows = best_fit(spread, 100).collect()
        assert sorted(r.item for r in rows) == list(range(len(lengths)))
        bins = defaultdict(list)
        for r in rows:
            bins[r.bin].append((r.offset, lengths[r.item]))
        for spots in bins.values():
            at = 0
            for offset, n in sorted(spots):
                assert offset == at
                at += n
            assert at <= 100
        assert len(bins) <= best_fit_decreasing(lengths, 100) * 1.02 + 1
        assert {(r.item, r.bin, r.offset) for r in best_fit(items, 100).collect()} == {
            (r.item, r.bin, r.offset) for r in rows
        }


def test_packing_odd_rows(spark):
    pieces = spark.createDataFrame(
        [(None, 8, "x"), (1, 8, "x"), (1, 3, "y"), (1, 3, "y")],
        "doc_id long, length long, number string",
    ).withColumns({"row": F.lit(1), "bin": F.lit(2), "offset": F.lit(9), "item": F.lit("i")})
    packed = pack_pieces(pieces, 8)
    assert packed.columns == ["doc_id", "length", "number", "row", "bin", "item", "sequence_id", "offset"]
    assert check_packing(packed.collect(), 8) == 3
    assert pack_pieces(pieces.limit(0), 8).count() == 0


def test_one_huge_text_is_cut_in_proportion(spark):
    """32 million characters take about four times as long as 8 million."""
    import time

    import pandas as pd
    from threadlens.llm.token_counts import CHUNK_CHARS, OVERLAP_CHARS, _cut

    def seconds(size):
        text = "ab ä" * (size // 4)
        frame = pd.DataFrame({"row": [1], "text": [text]})
        took = []
        for _ in range(3):
            start = time.process_time()
            parts = pd.concat(_cut(CHUNK_CHARS, OVERLAP_CHARS)(iter([frame])), ignore_index=True)
            took.append(time.process_time() - start)
        assert parts["k"].tolist() == list(range(-(-size // CHUNK_CHARS)))
        assert "".join(p[:CHUNK_CHARS] for p in parts["part"]) == text
        return min(took)

    assert seconds(32_000_000) < 12 * seconds(8_000_000)


def test_a_long_text_is_counted_as_a_whole(spark):
    whole = Tokenizer.from_file(BYTE_BPE)
    text = "".join(f"word {i} it's  a\n\n long text, " for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "a" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, BYTE_BPE).collect()}
    assert got[1] == len(whole.encode(text, add_special_tokens=False).ids)
    assert got[2] == len(whole.encode("a" * 100_000, add_special_tokens=False).ids)
