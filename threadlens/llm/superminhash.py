"""Shingle sets and SuperMinHash signatures of batches of texts, in numpy.

SuperMinHash gives every element a random permutation of the signature's registers: at
its step j it offers the value j + r (r uniform in [0, 1)) to the j-th register of its
permutation. A register keeps the smallest offer. An element so spreads its offers over
all registers, which makes the estimate of the similarity less variable than independent
hashes do. Once all registers of a text hold values below j, no later step can change
them: texts with many shingles stop after the first steps.
"""

from __future__ import annotations

import numpy as np
import xxhash

GOLD = np.uint64(0x9E3779B97F4A7C15)  # splitmix64's increment and multipliers
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FRACTION = np.uint64((1 << 48) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher: a bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``words`` words.

    Words lie between ASCII blanks, A-Z lower-cased; both rules are those of ``bytes``.
    A text of fewer words is one shingle; one without words has none. Two different
    shingles share a hash with a chance of 2^-64."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    found = np.full(n, width, np.uint64)
    for t in range(width):
        found = mix((found + GOLD) ^ word[t : t + n])
    return np.unique(found)


def signatures(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """(texts, registers) values, step in the upper 16 bits and fraction in the lower 48.
    Empty sets keep the largest value everywhere. At most 256 registers."""
    out = np.full((len(sets), registers), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not sizes.sum():
        return out
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = out.reshape(-1)
    places = None  # each element's permutation so far, from step 1 on
    for j in range(registers):
        draw = mix(element + np.uint64(int(GOLD) * (j + 1) % 2**64))
        pick = (draw >> np.uint64(32)) * np.uint64(registers - j) >> np.uint64(32)
        pick = pick.astype(np.int64) + j
        value = (np.uint64(j) << np.uint64(48)) | (mix(draw ^ GOLD) & _FRACTION)
        if places is None:
            register = pick
        else:
            rows = np.arange(len(element))
            register = places[rows, pick].astype(np.int64)
            places[rows, pick] = places[:, j]
        np.minimum.at(flat, owner * registers + register, value)
        highest = out.max(axis=1) >> np.uint64(48)
        going = (highest > j)[owner]
        if not going.any():
            break
        if places is None:
            element, owner, pick = element[going], owner[going], pick[going]
            places = np.tile(np.arange(registers, dtype=np.uint8), (len(element), 1))
            places[np.arange(len(element)), pick] = 0
        elif not going.all():
            element, owner, places = element[going], owner[going], places[going]
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) 64-bit keys: equal keys mean equal registers of a band."""
    texts, registers = values.shape
    bands = registers // rows
    parts = values[:, : bands * rows].reshape(texts, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, (texts, bands))
    for t in range(rows):
        key = mix((key + GOLD) ^ parts[:, :, t])
    return key
