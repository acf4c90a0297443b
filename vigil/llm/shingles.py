"""Word shingles of whole texts as 64-bit hashes, vectorised over the buffers of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE, _GAMMA = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for runs of rows of about ``size`` bytes; NULL is empty."""
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each row and in all) of a slice; words are runs without white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)  # a row begins here
    cut[offsets] = True
    inside = ~space
    before = np.concatenate([[True], space[:-1]]) | cut[:-1]
    after = np.concatenate([space[1:], [True]]) | cut[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    power, inverse = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row; fewer than k words are one shingle, no words none."""
    # Unrelated odd factors: shingles of the same words in another order differ.
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_GAMMA)) | np.uint64(1)
    for first, data, offsets in text_slices(column):
        words, bounds = word_hashes(data, offsets)
        total = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j, f in enumerate(factors):
            total += words[j:len(words) - k + 1 + j] * f if len(total) else total
        total = mix(total)
        bounds = bounds.tolist()
        for row, (a, b) in enumerate(zip(bounds, bounds[1:]), first):
            if b - a >= k:
                h = np.sort(total[a:b - k + 1])
                yield row, h[np.concatenate([[True], h[1:] != h[:-1]])]
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    short = mix(short * np.uint64(3) + words[j:j + 1])
                yield row, short
            else:
                yield row, np.zeros(0, np.uint64)
