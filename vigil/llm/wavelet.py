"""Wavelet matrix over token ids: one bit-plane per id bit, with rank directories (numbered operator 6).

Level ``l`` holds bit ``bits-1-l`` of every id, in the order left by stable partitions on the levels above
(zeros first).  ``ranks`` holds, for each level, the number of ones before every 512-bit block, so a rank
reads one directory entry and at most 64 bytes.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512


def build(ids: np.ndarray) -> tuple[list[int], list[int], bytes, bytes]:
    """(distinct ids, zeros of each level, bit-planes, rank directories) of the unsigned ``ids``.

    The planes hold each id's place among the distinct ids, so there are only as many as those need.
    """
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen)
    bits = max(1, (len(alphabet) - 1).bit_length())
    seq = (np.cumsum(seen) - 1).astype(np.uint16 if bits <= 16 else np.uint32)[ids]
    width, blocks = -(-len(seq) // 8), -(-len(seq) // BLOCK)
    # One buffer for all planes and one for the partitioned ids: no copy of a level outlives it.
    planes, ranks, zeros, spare = np.zeros((bits, width), np.uint8), np.zeros((bits, blocks + 1), "<u4"), [], np.empty_like(seq)
    for level in range(bits):
        one = (seq & seq.dtype.type(1 << (bits - 1 - level))) != 0
        planes[level] = np.packbits(one, bitorder="little")
        if width:
            np.cumsum(np.add.reduceat(np.bitwise_count(planes[level]), np.arange(0, width, BLOCK // 8), dtype=np.uint32), dtype=np.uint32, out=ranks[level, 1:])
        z = len(seq) - int(np.count_nonzero(one))
        spare[z:] = seq[one]
        spare[:z] = seq[np.logical_not(one, out=one)]
        zeros.append(z)
        seq, spare = spare, seq
    return alphabet.tolist(), zeros, planes.tobytes(), ranks.tobytes()


class WaveletMatrix:
    """Reads one shard: ``access``, ``rank``, ``count``, ``select``, ``occurrences`` and the whole sequence."""

    def __init__(self, n: int, alphabet: list[int], zeros: list[int], planes: bytes, ranks: bytes):
        self.n, self.alphabet, self.zeros, self.bits = n, np.array(alphabet, np.uint32), zeros, len(zeros)
        self._planes = np.frombuffer(planes, np.uint8).reshape(self.bits, -(-n // 8))
        self._ranks = np.frombuffer(ranks, "<u4").reshape(self.bits, -1)

    def _bit(self, level: int, i: int) -> int:
        return int(self._planes[level, i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones of a level before position i."""
        block = i // BLOCK
        at, plane = block * (BLOCK // 8), self._planes[level]
        found = int(self._ranks[level, block]) + int(np.bitwise_count(plane[at:i >> 3]).sum())
        return found + (int(plane[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a level: binary search in the directory, then in its block."""
        ones = self._ranks[level].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        at = block * (BLOCK // 8)
        inside = np.unpackbits(self._planes[level, at:at + BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(inside == bit)[k - int(before[block])])

    def _place(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[value])

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before position i."""
        if (token := self._place(token)) is None:
            return 0
        first = 0
        for level in range(self.bits):
            a, b = self._ones(level, first), self._ones(level, i)
            if token >> (self.bits - 1 - level) & 1:
                first, i = self.zeros[level] + a, self.zeros[level] + b
            else:
                first, i = first - a, i - b
        return i - first

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        token, at = self._place(token), 0
        for level in range(self.bits):
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else at - ones
        at += k
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids in order: the partitions are undone level by level."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for level in reversed(range(self.bits)):
            one = np.unpackbits(self._planes[level], count=self.n, bitorder="little").view(bool)
            out, z = np.empty(self.n, kind), self.zeros[level]
            out[np.flatnonzero(~one)] = seq[:z]
            out[np.flatnonzero(one)] = seq[z:] | kind(1 << (self.bits - 1 - level))
            seq = out
        return self.alphabet[seq]
