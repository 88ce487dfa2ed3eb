"""Phrases that occur in texts, a batch of texts at a time.

Testing one phrase after the other reads a text once per phrase. Here a text is read a few
times, whatever the number of phrases: of each phrase the three bytes that stand together
in the fewest places of the batch are looked up, and only there is it compared whole. Bytes
of UTF-8 decide, as in ``contains``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECE = 4_000_000  # bytes of text searched at a time
_KINDS = 63  # bytes are told apart as far as this goes; the comparison decides


def found(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Per group of phrases those that occur in ``text``, in order: ARRAY<ARRAY<STRING>>,
    null for a null text."""
    groups = [list(g) for g in groups]

    def find(texts: pa.Array) -> pa.Array:
        return occurring(texts, groups)

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, "array<array<string>>")(text)


def occurring(texts: pa.Array, groups: Sequence[Sequence[str]]) -> pa.Array:
    phrases = [p for g in groups for p in g]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    texts = texts.cast(pa.large_string())
    rows, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for first, piece in pieces(texts):
        for i, own in _places(piece, [p.encode() for p in phrases]):
            rows.append(own + first)
            which.append(np.full(len(own), i))
    row, which = np.concatenate(rows), np.concatenate(which)
    order = np.lexsort((which, row))
    row, which = row[order], which[order]
    n = len(texts)
    ends = np.searchsorted(row * len(groups) + group[which], np.arange(n * len(groups) + 1))
    inner = pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(phrases, pa.string()).take(pa.array(which))
    )
    outer = pa.array(np.arange(n + 1) * len(groups), pa.int32())
    return pa.ListArray.from_arrays(outer, inner, mask=texts.is_null())


def pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(number of the first text, texts) of about ``_PIECE`` bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(size) // _PIECE
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(texts)]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield int(low), texts.slice(low, high - low)


def _places(texts: pa.Array, phrases: Sequence[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a phrase, numbers of the texts that hold it)."""
    texts = pc.fill_null(texts, "")
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[starts[0] : starts[-1]] if held else np.empty(0, np.uint8)
    ends = starts[1:] - starts[0]
    kind = np.zeros(256, np.int32)
    letters = sorted({b for p in phrases for b in p})
    kind[letters] = np.arange(len(letters)) % _KINDS + 1
    three = lambda c: (c[:-2] << 12) | (c[1:-1] << 6) | c[2:]
    codes = three(kind[data])
    counts = np.bincount(codes, minlength=1 << 18)
    anchors = {}
    for i, p in enumerate(phrases):
        if len(p) >= 3:
            own = three(kind[np.frombuffer(p, np.uint8)])
            at = int(counts[own].argmin())
            if counts[own[at]]:
                anchors[i] = at, own[at]
        else:
            yield i, np.flatnonzero(
                pc.match_substring(texts, p.decode()).to_numpy(zero_copy_only=False)
            )
    wanted = np.zeros(1 << 18, bool)
    wanted[[code for _, code in anchors.values()]] = True
    places = np.flatnonzero(wanted[codes])
    code_at = codes[places]
    order = np.argsort(code_at, kind="stable")
    places, code_at = places[order], code_at[order]
    for i, (at, code) in anchors.items():
        low, high = np.searchsorted(code_at, [code, code + 1])
        p = phrases[i]
        start = places[low:high] - at
        start = start[(start >= 0) & (start + len(p) <= len(data))]
        for j, byte in enumerate(p):
            start = start[data[start + j] == byte]
        row = np.searchsorted(ends, start, "right")
        yield i, np.unique(row[start + len(p) <= ends[row]])
