"""Tokenizing inside a task: every distinct segment of a text is encoded once.

Both vocabularies used here cut a text into words before merging, and never across the
places named below, so a text's tokens are those of its segments one after the other.
A cache of the segments met so far saves most of the work on natural text; new segments
share their words, without the stops behind them, and plain words go straight to the
vocabulary's merges."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

# White space as Unicode defines it; the tokenizers' \s.
SPACE = "\\t-\\r " + "".join(
    map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# A byte-level pattern never runs from a non-blank into a blank, so each run of blanks
# goes with the word after it.
BYTE_LEVEL_SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

# Stops behind a letter are words of their own to both patterns.
STOPS = ".,;:!?"

CACHED_SEGMENTS = 700_000
SLICE_CHARS = 3_000_000


def load_tokenizer(path: str):
    """The tokenizer of a vocabulary file, one thread per task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def slices(texts: Iterable[str], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Neighbouring texts in lists of about ``chars`` characters."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def word_cut(text: str) -> list[bytes]:
    """For vocabularies that drop white space: the words between ASCII blanks."""
    return text.encode("utf-8").split()


def fold(words: list[bytes]) -> list[str]:
    """Words as such a vocabulary sees them: it lower-cases what is no special string."""
    together = b" ".join(words)
    if b"<|" not in together:
        return together.lower().decode("utf-8").split(" ") if words else []
    return [(w if b"<|" in w else w.lower()).decode("utf-8") for w in words]


def byte_level_cut(text: str) -> list[str]:
    """For byte-level vocabularies, which keep white space."""
    return BYTE_LEVEL_SEGMENT.findall(text)


class Cache:
    """What a worker has encoded with one vocabulary, in two generations of up to half the
    ``limit`` each: once the younger one is full it becomes the older one, from which what
    is met again moves back. Frequent segments so stay, whatever the number of rare ones."""

    def __init__(self, limit: int):
        self.half = max(limit // 2, 1)
        self.young: dict = {}
        self.old: dict = {}

    def found(self, keys: Iterable) -> tuple[dict, list]:
        """The known ones of distinct ``keys``, and the others."""
        young, old = self.young, self.old
        here, fresh = {}, []
        for k in keys:
            v = young.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    fresh.append(k)
                    continue
                young[k] = v
            here[k] = v
        return here, fresh

    def add(self, more: dict) -> None:
        if len(self.young) + len(more) > self.half:
            self.old, self.young = self.young, {}
        self.young.update(more)


_CACHES: dict[tuple, tuple[Cache, Cache]] = {}  # a worker runs many tasks


def encoded_segments(
    tokenizer, texts: Iterable[str], cut: Callable[[str], list], plain: Callable = list,
    joint: str = "", limit: int = CACHED_SEGMENTS, name: str | None = None,
) -> Iterator[Iterable[bytes]]:
    """For each text the token ids of its segments, as little-endian 32-bit numbers.

    ``cut`` gives a text's segments and ``plain`` the texts of segments. ``joint`` is what
    stands before a word of letters in a segment that holds only it. ``name`` names the
    vocabulary: what a worker has encoded with it serves its later tasks as well."""
    key = (name, joint, limit)
    caches = _CACHES.get(key) or (Cache(limit), Cache(limit))
    if name is not None:
        _CACHES[key] = caches
    segments, words = caches
    for part in slices(texts):
        pieces = [cut(t) for t in part]
        known, fresh = segments.found(set(chain.from_iterable(pieces)))
        if fresh:
            whole = plain(fresh)
            heads = list(map(_without_stops, whole))
            tails = [w[len(h) :] for w, h in zip(whole, heads)]
            ids, new = words.found({*heads, *tails})
            made = dict(_encode_words(tokenizer, [w for w in new if w], joint))
            words.add(made)
            ids.update(made)
            ids[""] = b""
            found = {f: ids[h] + ids[t] for f, h, t in zip(fresh, heads, tails)}
            segments.add(found)
            known.update(found)
        for own in pieces:
            yield map(known.__getitem__, own)


def _without_stops(text: str) -> str:
    word = text.rstrip(STOPS)
    return word if word[-1:].lower().isalpha() else text


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they
    are, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


def _encode_words(tokenizer, texts: list[str], joint: str) -> Iterator[tuple[str, bytes]]:
    """A word of letters, with or without ``joint`` before it, is one match of the
    vocabularies' patterns: it goes straight to their merges, unless normalising would
    change it. Everything else goes the whole way."""
    merge, skip = tokenizer.model.tokenize, len(joint)
    as_is = tokenizer.normalizer is None
    rest = []
    for t in texts:
        word = t[skip:] if skip and t.startswith(joint) else t
        if word.isalpha() and (as_is or word.isascii() and word.islower() or (
            word == word.lower() and unicodedata.is_normalized("NFC", word)
        )):
            written = t if t.isascii() and word is t else (
                t.encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)
            )
            yield t, array("I", [x.id for x in merge(written)]).tobytes()
        else:
            rest.append(t)
    for at in range(0, len(rest), 4096):
        some = rest[at : at + 4096]
        for text, encoding in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
            yield text, array("I", encoding.ids).tobytes()
