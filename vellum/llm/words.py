"""Words and pieces of many texts as byte ranges of one buffer, hashed all at once.

Numpy finds the ranges and hashes them, so that no Python object is made for a word and what a worker remembers of
words lies in arrays of a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; the powers of the base are kept for so many.
BLOCK = 1 << 18
#: Ranges of more bytes are hashed one by one.
LONG = 256

_random = np.random.default_rng(20240229)
_BASE = int(_random.integers(0, 1 << 64, dtype=np.uint64)) | 1
_CODES = _random.integers(0, 1 << 64, 256, np.uint64)
_POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(BLOCK - 1, _BASE, np.uint64)])
_INVERSES = np.multiply.accumulate(np.r_[np.uint64(1), np.full(BLOCK - 1, pow(_BASE, -1, 1 << 64), np.uint64)])

#: As _CODES, with A-Z taken for a-z.
_FOLDED = _CODES.copy()
_FOLDED[0x41:0x5B] = _CODES[0x61:0x7B]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Which bytes part words: the space and U+0009 to U+000D.
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """All bits of each number depend on all of its bits."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def runs(starts: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(i, j): consecutive ranges that span `most` bytes together, or one that is longer alone."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        yield i, j
        i = j


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each range of the bytes, which depends on its bytes alone; fold: A-Z count as a-z.

    The ranges are in order and don't overlap. The hash is a polynomial in an odd base modulo 2**64: sums of the
    bytes' codes times powers run over the buffer once, and each range is the difference of two, moved to power 0.
    With that modulus ranges of 1,024 bytes and more can be made that collide under every base and all codes (the
    Thue-Morse sequence and its mirror), so those over LONG bytes are hashed by BLAKE2b.
    """
    codes, out = _FOLDED if fold else _CODES, np.zeros(len(starts), np.uint64)
    total = np.zeros(BLOCK + 1, np.uint64)
    for i, j in runs(starts, ends, BLOCK):
        base, size = int(starts[i]), int(ends[j - 1] - starts[i])
        if size > BLOCK:
            continue
        np.cumsum(codes[raw[base : base + size]] * _POWERS[:size], out=total[1 : size + 1])
        at = starts[i:j] - base
        out[i:j] = (total[ends[i:j] - base] - total[at]) * _INVERSES[at]
    out = mixed(out + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG):
        own = raw[starts[k] : ends[k]]
        digest = hashlib.blake2b((_LOWER[own] if fold else own).tobytes(), digest_size=8).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one row after the other, and where each row begins, with the end; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_ranges(raw: np.ndarray, at: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and how many each row has; `at` as buffer_of gives it; gap: the bytes that part words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    word = ~gap[raw]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    # a row ends a word, whatever the next one begins with
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = word[first]
    stops[first[1:] - 1] = word[first[1:] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.diff(np.searchsorted(starts, at))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows one after the other, A-Z as a-z, and how many each row has."""
    raw, at = buffer_of(column)
    starts, ends, counts = word_ranges(raw, at)
    return range_hashes(raw, starts, ends, fold=True), counts
