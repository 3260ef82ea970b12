"""Words and shingles of Arrow string columns as numpy arrays, a whole batch at a time.

A word is a run of bytes other than space and tab to carriage return, with A-Z
lower-cased. Words are known by 64-bit polynomial hashes taken from prefix sums, so the
cost is a few passes over the bytes, whatever the words' lengths, with no Python loop a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18  #: bytes handled at a time: bounds the memory of the prefix sums
PART_BYTES = 1 << 21  #: bytes of rows whose words are held at a time, but for a longer row
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd multipliers of the places in a shingle.
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for b in (_BASE, inverse):
            a = np.full(n, b, dtype=np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers = both[0], both[1]
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the rows' offsets in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of the bytes into about SEGMENT each, at row ends or white space, so that no word is cut."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + SEGMENT, end)
        if to < end:
            row = offsets[np.searchsorted(offsets, to, "right") - 1]
            if row > at:
                to = int(row)
            else:  # one row longer than a segment
                spaces = np.flatnonzero(_SPACE[data[at:to]])
                if len(spaces):
                    to = at + int(spaces[-1]) + 1
                else:
                    stop = int(offsets[np.searchsorted(offsets, at, "right")])
                    while to < stop and not _SPACE[data[to]]:
                        to += 1
        yield at, to
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, in order, and the number of words of each row."""
    hashes, rows = [], []
    starts_of_rows = offsets[:-1][np.diff(offsets) > 0]
    for at, to in _segments(data, offsets):
        d = data[at:to]
        inside = ~_SPACE[d]
        if not inside.any():
            continue
        cut = np.zeros(len(d) + 1, dtype=bool)
        near = starts_of_rows[np.searchsorted(starts_of_rows, at) : np.searchsorted(starts_of_rows, to)]
        cut[near - at] = True
        cut[0] = cut[-1] = True
        begin = inside & (cut[:-1] | np.concatenate(([True], ~inside[:-1])))
        stop = inside & (cut[1:] | np.concatenate((~inside[1:], [True])))
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        power, inverse = _power(len(d) + 1)
        sums = np.zeros(len(d) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[d] * power[: len(d)], out=sums[1:])
        h = (sums[e] - sums[s]) * inverse[s]
        hashes.append(mix(h ^ ((e - s).astype(np.uint64) * np.uint64(_BASE))))
        rows.append(np.searchsorted(offsets, s + at, "right") - 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    return np.concatenate(hashes), np.bincount(np.concatenate(rows), minlength=len(offsets) - 1)


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows at .. to of about PART_BYTES each; a single row is never divided."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, "right")) - 1)
        yield at, to
        at = to


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles; with fewer words than ``width`` the whole sequence is one, without words none."""
    data, offsets = text_bytes(column)
    for first, last in _runs(offsets):
        yield from _shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    words, counts = word_hashes(data, offsets)
    n = len(words) - width + 1
    if n > 0:
        grams = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            grams += words[k : k + n] * _PLACES[k]
        grams = mix(grams)
    at = 0
    for c in counts.tolist():
        if c >= width:
            yield np.unique(grams[at : at + c - width + 1])
        elif c:
            short = np.uint64(0)
            with np.errstate(over="ignore"):
                for k in range(c):
                    short += words[at + k] * _PLACES[k + 8]
                short += np.uint64(c)
            yield mix(np.array([short], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)
        at += c
