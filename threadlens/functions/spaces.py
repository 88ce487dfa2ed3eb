"""Runs of spaces and of other characters to single spaces, a batch of texts at a time.

A text here has a space every few bytes, and a pattern is tried at every character. Bytes of
UTF-8 are looked up in a table instead, all of a batch at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.phrases import pieces

_SPACE = 32
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[[*range(9, 14), *range(28, 32)]] = _SPACE
# Visible ASCII but for letters, digits and the apostrophe, and all beyond ASCII.
_PLAIN = np.full(256, _SPACE, np.uint8)
_PLAIN[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'"]] = [
    *b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'"
]
# Spaces of more than one byte.
_WIDE = [
    chr(c).encode()
    for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
]
_LEADS = np.zeros(256, bool)
_LEADS[[w[0] for w in _WIDE]] = True


def squashed(text: Column) -> Column:
    """Runs of whitespace (``text.WS``) as one space, none at the ends; null for null."""
    return _by_batch(text, _blank_spaces)


def plain(text: Column) -> Column:
    """Runs of all but a-z, A-Z, 0-9 and the apostrophe (``text.NOT_PLAIN``) as one space,
    none at the ends; null for null."""
    return _by_batch(text, lambda data: _PLAIN[data])


def _by_batch(text: Column, blank: Callable[[np.ndarray], np.ndarray]) -> Column:
    def squash(texts: pa.Array) -> pa.Array:
        return single_spaced(texts, blank)

    squash.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(squash, "string")(text)


def _blank_spaces(data: np.ndarray) -> np.ndarray:
    out = _SPACES[data]
    lead = np.flatnonzero(_LEADS[data])
    for wide in _WIDE if len(lead) else ():
        at = lead[lead + len(wide) <= len(data)]
        for i, byte in enumerate(wide):
            at = at[data[at + i] == byte]
        for i in range(len(wide)):
            out[at + i] = _SPACE
    return out


def single_spaced(texts: pa.Array, blank: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """The texts with the bytes that ``blank`` makes spaces, runs of them as one."""
    done = [pa.array([], pa.string())]
    for _, piece in pieces(texts.cast(pa.large_string())):
        done.append(_single_spaced(piece, blank))
    out = pa.concat_arrays(done)
    return pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), out) if texts.null_count else out


def _single_spaced(texts: pa.Array, blank: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    texts = pc.fill_null(texts, "")
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[starts[0] : starts[-1]] if held else np.empty(0, np.uint8)
    starts = starts - starts[0]
    out = blank(data)
    # Of a run the last space stays, none at the end of a text.
    space = out == _SPACE
    after = np.ones(len(out), bool)
    after[:-1] = space[1:]
    after[starts[1:][starts[1:] > starts[:-1]] - 1] = True
    keep = ~(space & after)
    before = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    out, starts = out[keep], before[starts]
    # Nor does one at the beginning.
    filled = starts[1:] > starts[:-1]
    leading = np.zeros(len(filled), bool)
    leading[filled] = out[starts[:-1][filled]] == _SPACE
    out = np.delete(out, starts[:-1][leading])
    starts[1:] -= np.cumsum(leading)
    return pa.StringArray.from_buffers(
        len(texts), pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(out.tobytes())
    )
