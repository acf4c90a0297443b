"""Periodic runs of words inside each text (numbered operator 12), by string synchronising sets at dyadic scales.

A run is a maximal stretch of at least two periods q.  For the scale w = 2**k a position is synchronising where the
least hash among the next w + 1 windows of w words stands at either end: this depends on the 2w words behind the
position alone (its context), so a run of period 3w <= q < 6w repeats its synchronising positions q words later.
Pairs of positions with equal contexts less than 6w apart propose (place, period); non-periodic contexts recur
more than w/3 words apart, so a position has less than 18 partners.  Windows with a period of w/3 or less are left out
of the choice of positions.  What that omits comes from the highly periodic regions themselves, which are
runs found at lower scales: two regions of one period whose ends lie 3w to 6w apart propose that distance, and two
that touch propose each distance that keeps their phase.  Periods up to ``DIRECT`` are compared word by word.
Every proposal is extended to both sides through hashes of dyadic windows (64 bits, mixed anew at each level).

Documents of one slice that are alike in length are searched together.  Memory is some 200 bytes a word of a
slice or of the longest text.

Defined results: a NULL or empty text has no words and no runs; equal rows give equal results; a row with a NULL id
is searched as it is; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigil.llm.common import column, small_batches
from vigil.llm.shingles import mix

#: Periods compared word by word; the first scale begins where they end.
DIRECT, FIRST = 24, 3
#: Least length of a stretch kept as a highly periodic region.
REGION = 8
SLICE_CHARS = 2 << 20
_LAST = np.uint64(2**64 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Found:
    """Stretches (start, end, period); of those with equal ends the smallest period counts."""

    def __init__(self):
        self.start = self.end = self.period = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        s, e, q = (np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((q, e, s))
        s, e, q = s[order], e[order], q[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        self.start, self.end, self.period = s[new], e[new], q[new]


def _levels_up(levels: list[np.ndarray]) -> None:
    """Adds the hashes of windows twice as long."""
    last, half = levels[-1], 1 << (len(levels) - 1)
    a, b = last[:max(0, len(last) - half)], last[half:]
    levels.append(mix(a * _ODD + mix(b + np.uint64(len(levels)))))


def _extend(levels: list[np.ndarray], x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest stretches of period q about the places x."""
    right, left, top = x.copy(), x.copy(), len(levels) - 1
    for k in range(top, -1, -1):
        h, step = levels[k], 1 << k
        active = np.arange(len(x))
        while len(active):
            y = right[active] + q[active]
            active, y = active[y < len(h)], y[y < len(h)]
            active = active[h[y - q[active]] == h[y]]
            right[active] += step
            active = active if k == top else active[:0]
        active = np.arange(len(x))
        while len(active):
            y = left[active] - step
            active, y = active[(y >= 0) & (y + q[active] < len(h))], y[(y >= 0) & (y + q[active] < len(h))]
            active = active[h[y] == h[y + q[active]]]
            left[active] -= step
            active = active if k == top else active[:0]
    return left, right + q


def _add_proposals(found: _Found, levels: list[np.ndarray], x: np.ndarray, q: np.ndarray, covered: int) -> None:
    """Extends the proposals; one within ``covered`` words behind another of its period lies in the same stretch."""
    if not len(x):
        return
    order = np.lexsort((x, q))
    x, q = x[order], q[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (q[1:] != q[:-1]) | (x[1:] - x[:-1] > covered)
    x, q = x[keep], q[keep]
    start, end = _extend(levels, x, q)
    full = end - start >= 2 * q
    found.add(start[full], end[full], q[full])


def _near_pairs(group: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, distance) of all pairs of one group that are low <= distance < high apart; sorted by group, then place."""
    firsts, gaps, shift = [], [], 1
    while shift < len(at):
        gap = at[shift:] - at[:-shift]
        near = (group[shift:] == group[:-shift]) & (gap < high)
        if not near.any():
            break
        near &= gap >= low
        firsts.append(at[:-shift][near])
        gaps.append(gap[near])
        shift += 1
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (firsts, gaps))


def _synchronising(levels: list[np.ndarray], k: int, found: _Found) -> np.ndarray:
    """The synchronising positions of the scale 2**k."""
    w, ids = 1 << k, levels[k].copy()
    dense = (found.period <= w // 3) & (found.end - found.start >= w)
    marks = np.zeros(len(ids) + 1, np.int32)
    np.add.at(marks, found.start[dense], 1)
    np.add.at(marks, found.end[dense] - w + 1, -1)
    ids[np.cumsum(marks[:-1]) > 0] = _LAST
    least = ids
    for b in range(k):
        least = np.minimum(least[:-(1 << b)], least[1 << b:])
    least = np.minimum(least[:-1], least[1:])
    n = len(least)
    return np.flatnonzero(((least == ids[:n]) | (least == ids[w:w + n])) & (least != _LAST))


def _touching(found: _Found, levels: list[np.ndarray]) -> None:
    """Periods across the meeting point of two touching regions of one small period."""
    wide = found.end - found.start >= np.maximum(DIRECT, 9 * found.period)
    order = np.flatnonzero(wide)[np.lexsort((found.start[wide], found.period[wide]))]
    a, b, p = found.start[order], found.end[order], found.period[order]
    meet = np.flatnonzero((p[1:] == p[:-1]) & (a[1:] <= b[:-1]))
    xs, qs = [], []
    for m in meet.tolist():
        a1, b1, a2, b2, q = (int(v) for v in (a[m], b[m], a[m + 1], b[m + 1], p[m]))
        k = q.bit_length() - 1
        h, rest = levels[k], q - (1 << k)
        y = np.arange(a2, a2 + q)
        same = np.flatnonzero((h[y] == h[b1 - q]) & (h[y + rest] == h[b1 - q + rest]))
        if len(same):
            first = a2 + int(same[0]) - (b1 - q)
            period = np.arange(first % q, min(b1 - a1, b2 - a2, (b2 - a1) // 2) + 1, q, dtype=np.int64)
            period = period[period > DIRECT]
            qs.append(period)
            xs.append(np.maximum(a1, a2 - period))
    if qs:
        _add_proposals(found, levels, np.concatenate(xs), np.concatenate(qs), 0)


def stretches(t: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all maximal stretches of two periods or more, at least ``REGION`` long, in the numbers ``t``.

    Texts are parted by numbers that occur once; ``longest`` bounds their length.
    """
    found = _Found()
    parts = []
    for q in range(1, min(DIRECT, longest // 2) + 1):
        same = np.flatnonzero(t[q:] == t[:-q])
        if len(same):
            cut = np.flatnonzero(np.diff(same) > 1)
            first, last = same[np.concatenate([[0], cut + 1])], same[np.concatenate([cut, [len(same) - 1]])] + 1
            full = last - first >= max(REGION, 2 * q) - q
            parts.append((first[full], last[full] + q, np.full(int(full.sum()), q, np.int64)))
    if parts:
        found.add(*(np.concatenate(v) for v in zip(*parts)))
    if longest <= 2 * DIRECT:
        return found.start, found.end, found.period
    levels = [mix(t.astype(np.uint64) * _ODD + np.uint64(1))]
    for k in range(FIRST, longest.bit_length()):
        w = 1 << k
        if 6 * w > longest or 2 * w > len(t):
            break
        while len(levels) < k + 2:
            _levels_up(levels)
        at = _synchronising(levels, k, found)
        context = levels[k + 1][at]
        order = np.argsort(context, kind="stable")
        context, at = context[order], at[order]
        again = np.zeros(len(at), bool)
        again[1:] = context[1:] == context[:-1]
        again[:-1] |= again[1:].copy()
        pairs = [_near_pairs(context[again], at[again], 3 * w, 6 * w)]
        regions = (found.period <= w // 3) & (found.end - found.start >= 3 * w - 1)
        order = np.lexsort((found.end[regions], found.period[regions]))
        first, gap = _near_pairs(found.period[regions][order], found.end[regions][order], 3 * w, 6 * w)
        _add_proposals(found, levels, *pairs[0], 2 * w)
        _add_proposals(found, levels, first - 1, gap, 0)
    _touching(found, levels)
    return found.start, found.end, found.period


def runs_of(words: list[np.ndarray], least: int = 12) -> list[np.ndarray]:
    """For every list of word numbers its runs: rows (start, length, period) by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(words)
    classes: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) >= least:
            classes.setdefault(len(w).bit_length(), []).append(k)
    for members in classes.values():
        sizes = np.array([len(words[k]) for k in members], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        t = np.empty(int(starts[-1]), np.int64)
        t[starts[1:] - 1] = -1 - np.arange(len(members))
        for k, a in zip(members, starts.tolist()):
            t[a:a + len(words[k])] = words[k]
        s, e, q = stretches(t, int(sizes.max()))
        full = e - s >= np.maximum(least, 2 * q)
        s, e, q = s[full], e[full], q[full]
        order = np.lexsort((q, s))
        s, e, q = s[order], e[order], q[order]
        bounds = np.searchsorted(s, starts)
        for n, k in enumerate(members):
            a, b = bounds[n], bounds[n + 1]
            if b > a:
                out[k] = np.stack([s[a:b] - starts[n], (e - s)[a:b], q[a:b]], 1)
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run keeps its first period alone."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(marks[:-1]) == 0


def repeated_tail(doc_id: int, n: int) -> np.ndarray | None:
    """Word numbers of a text whose tail is made periodic, as the id's checksum says; None: the text as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _searched(ids: list, texts: list, rewrite) -> tuple[list[np.ndarray], list[bytes]]:
    """(runs, collapsed text) of every text of a slice."""
    numbers, words, coded = _Numbers(), [], []
    for doc_id, text in zip(ids, texts):
        w = (text or "").encode().split()  # at ASCII white space
        at = rewrite(doc_id, len(w)) if rewrite and doc_id is not None else None
        if at is not None:
            w = [w[k] for k in at.tolist()]
        words.append(w)
        coded.append(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)))
    found = runs_of(coded)
    collapsed = [b" ".join(w if not len(r) else [w[k] for k in np.flatnonzero(kept_words(len(w), r)).tolist()]) for w, r in zip(words, found)]
    return found, collapsed


def _slices(batches: Iterator[pa.RecordBatch]):
    """(batch, rows, ids, texts) in runs of about ``SLICE_CHARS`` characters."""
    for batch in batches:
        first, held, texts = 0, 0, []
        for k, text in enumerate(batch.column("text")):
            texts.append(text.as_py())
            held += len(texts[-1] or "")
            if held >= SLICE_CHARS or k + 1 == batch.num_rows:
                yield batch.slice(first, len(texts)), batch.column("id").slice(first, len(texts)).to_pylist(), texts
                first, held, texts = k + 1, 0, []


def _summary(found: list[np.ndarray], collapsed: list[bytes]) -> list[pa.Array]:
    columns: list[list] = [[] for _ in range(7)]
    for runs, text in zip(found, collapsed):
        best = [None] * 4
        if len(runs):
            s, n, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
            best = [s, n, q, 1000 * n // q]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
        for c, v in zip(columns, (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())):
            c.append(v)
    return [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]


def _digest(rewrite):
    names = ["id", *[c.split()[0] for c in DIGEST.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, texts in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), *_summary(*_searched(ids, texts, rewrite))], names)
    return run


def _full(rewrite):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, texts in _slices(batches):
            found, collapsed = _searched(ids, texts, rewrite)
            runs = [[dict(zip(("start", "length", "period"), r)) for r in f.tolist()] for f in found]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(runs, kind), pa.array([c.decode() for c in collapsed])], ["id", "runs", "collapsed"])
    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rewrite=None) -> DataFrame:
    """id, all runs (word number, length, period) and the text with every run cut to its first period, words joined by a blank.

    ``rewrite(id, n)`` may name, for a text of n words, the word number that stands at each place.
    """
    schema = "id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return _rows(docs, id_col, text_col).mapInArrow(_full(rewrite), schema).withColumnRenamed("id", id_col)


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rewrite=None) -> DataFrame:
    """id, the number of runs, the longest one, and checksums of all runs and of the collapsed text."""
    return _rows(docs, id_col, text_col).mapInArrow(_digest(rewrite), "id long, " + DIGEST).withColumnRenamed("id", id_col)
