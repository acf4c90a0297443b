"""Benchmark decontamination by Wu-Manber multi-pattern search over words (numbered operator 7).

Patterns are windows of ``window`` consecutive item words (a shorter item is one window).  Patterns of one
length form one searcher.  Its shift table, indexed by a hash of the block of the last two words under the
cursor, tells how far the cursor may move; a shift of zero leads to the bucket of patterns that end in
that block hash, and the words themselves are compared.  Words are numbered by an exact dictionary of the
benchmark's words (0: not in it), so equal numbers mean equal words.  Many stretches of text are searched
in step, one cursor each, with numpy.

The benchmark is read in groups of at most ``PATTERN_CHARS`` characters: each group is one broadcast of
bounded size and one pass over the documents; results of earlier passes are carried along.

Defined results: texts without words (NULL, empty) have no hits, items without words no windows; a NULL
item id marks hits but is not listed; rows of one item id count as one item; repeated documents are judged
alike; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import column, small_batches, written

#: Characters of benchmark text searched for at once: some 25 bytes of tables for each.
PATTERN_CHARS = 4 << 20
#: Entries of a shift table, at most 2 to this.
MOST_BITS = 22
SLICE_BYTES, STRETCH, OPEN = 4 << 20, 512, 1 << 22
#: A word of the contract, in lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Word bytes: 0-9, A-Z (lower-cased), a-z and every byte of a character beyond ASCII.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Searcher:
    """Wu-Manber tables for distinct patterns (rows of word numbers) of one length."""

    def __init__(self, patterns: np.ndarray):
        self.patterns, (n, self.m) = patterns, patterns.shape
        self.b = min(2, self.m)
        self.bits = min(MOST_BITS, max(8, (4 * n * self.m).bit_length()))
        shift = np.full(1 << self.bits, self.m - self.b + 1, np.int32)
        for end in range(self.b - 1, self.m):  # blocks near the pattern's end leave the smaller shift
            np.minimum.at(shift, self._hash(patterns, end), self.m - 1 - end)
        self.shift = shift
        last = self._hash(patterns, self.m - 1)
        self.bucket = np.argsort(last, kind="stable")
        self.first = np.searchsorted(last[self.bucket], np.arange((1 << self.bits) + 1))

    def _hash(self, rows: np.ndarray, end: int) -> np.ndarray:
        return self._code(rows[:, end], rows[:, end - 1] if self.b == 2 else np.zeros(len(rows), rows.dtype))

    def _code(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        mixed = (last.astype(np.uint64) + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, pattern number) of every occurrence inside the documents [start, end)."""
        size = np.maximum(ends - starts - (self.m - 1), 0)
        parts = -(-size // STRETCH)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cursor = np.repeat(starts + self.m - 1, parts) + inside * STRETCH
        stop = np.minimum(cursor + STRETCH, np.repeat(ends, parts))
        zero = []
        while len(cursor):
            step = self.shift[self._code(text[cursor], text[cursor - 1] if self.b == 2 else np.zeros(len(cursor), text.dtype))]
            zero.append(cursor[step == 0])
            cursor = cursor + np.maximum(step, 1)
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
        at = np.concatenate(zero) if zero else np.zeros(0, np.int64)
        found_at, found, lo = [], [], 0
        codes = self._code(text[at], text[at - 1] if self.b == 2 else np.zeros(len(at), text.dtype))
        opened = np.cumsum(self.first[codes + 1] - self.first[codes])
        while lo < len(at):  # buckets are opened in runs of about OPEN comparisons
            hi = max(lo + 1, int(np.searchsorted(opened, (opened[lo - 1] if lo else 0) + OPEN, side="right")))
            run, code = at[lo:hi], codes[lo:hi]
            lo = hi
            n = self.first[code + 1] - self.first[code]
            where = np.repeat(run - self.m + 1, n)
            which = self.bucket[np.repeat(self.first[code], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            for j in range(self.m):  # direct comparison, first words first
                same = text[where + j] == self.patterns[which, j]
                where, which = where[same], which[same]
            found_at.append(where)
            found.append(which)
        return (np.concatenate(found_at), np.concatenate(found)) if found else (at, at)


class Patterns:
    """The searchers of one group of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.number: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items if i is not None})
        place = {name: k for k, name in enumerate(self.names)}
        rows: dict[int, list[np.ndarray]] = defaultdict(list)  # length of the pattern -> its word numbers, rows of it
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text.encode())], np.int32)
            if len(ids):
                m = min(window, len(ids))
                rows[m].append(np.lib.stride_tricks.sliding_window_view(ids, m))
                owners[m].append(np.full(len(ids) - m + 1, place.get(item, -1), np.int32))
        self.searchers = []
        for m in sorted(rows):
            every = np.ascontiguousarray(np.concatenate(rows.pop(m)))
            _, first, which = np.unique(every.view(np.dtype((np.void, 4 * m))).ravel(), return_index=True, return_inverse=True)
            owner = np.concatenate(owners.pop(m))
            # (pattern, item) once each, by pattern: the items of pattern p are held[starts[p]:starts[p + 1]]
            pairs = np.unique(which.astype(np.int64) << 32 | owner.astype(np.int64) & 0xFFFFFFFF)
            pairs = pairs[(pairs & 0xFFFFFFFF) != 0xFFFFFFFF]  # an item without an id has no name
            starts = np.searchsorted(pairs >> 32, np.arange(len(first) + 1))
            self.searchers.append((Searcher(every[first]), starts, (pairs & 0xFFFFFFFF).astype(np.int32)))

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """(number of words, hit word intervals, items) of each text."""
        rows = [words(t) for t in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(sizes.sum())
        text = np.fromiter((i for r in rows for i in map(self.number.get, r, repeat(0))), np.int32, total)
        marks, items = np.zeros(total + 1, np.int32), defaultdict(set)
        for searcher, first, held in self.searchers:
            at, which = searcher.search(text, starts, ends)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + searcher.m, -1)
            for doc, pattern in set(zip((np.searchsorted(ends, at, side="right")).tolist(), which.tolist())):
                items[doc].update(self.names[k] for k in held[first[pattern]:first[pattern + 1]].tolist())
        hit = np.cumsum(marks[:-1]) > 0
        out = []
        any_hit = np.flatnonzero(hit)
        docs_hit = set(np.unique(np.searchsorted(ends, any_hit, side="right")).tolist())
        for k, n in enumerate(sizes.tolist()):
            spans = []
            if k in docs_hit:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[starts[k]:ends[k]].view(np.int8), [0]])))
                spans = edges.reshape(-1, 2).tolist()
            out.append((n, spans, items.get(k, set())))
        return out


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _found(patterns: "Patterns", column: pa.Array) -> list[tuple[int, list, set]]:
    """(number of words, hit word intervals, items) of each text of an Arrow column, in slices."""
    results, held, part = [], 0, []
    for text in column.cast(pa.binary()):
        part.append(text.as_py() or b"")
        held += len(part[-1])
        if held > SLICE_BYTES:
            results += patterns.scan(part)
            held, part = 0, []
    return results + patterns.scan(part)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _listed(spans: list) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS)


def _scan(shared, carried: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = _found(shared.value, batch.column(text_at))
            columns = [*(batch.column(k) for k in range(len(carried))), pa.array([r[0] for r in results], pa.int64()),
                       _listed([r[1] for r in results]), pa.array([sorted(r[2]) for r in results], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "n_words", "spans", "items"])
    return run


def _hits(shared):
    """(_row, spans, items) of the texts with a hit alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = _found(shared.value, batch.column("text"))
            hit = [k for k, r in enumerate(results) if r[1]]
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(hit, pa.int64())), _listed([results[k][1] for k in hit]),
                                              pa.array([sorted(results[k][2]) for k in hit], pa.list_(pa.string()))], ["_row", "spans", "items"])
    return run


def _merge(carried: list[str]):
    """Joins the word intervals that the groups found in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merged([[x["start"], x["end"]] for part in s or [] for x in part]) for s in batch.column("spans").to_pylist()]
            items = [sorted({x for part in s or [] for x in part}) for s in batch.column("items").to_pylist()]
            sizes = [len(words(t.as_py() or b"")) for t in batch.column("_text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(sizes, pa.int64()), _listed(spans), pa.array(items, pa.list_(pa.string()))],
                                             [*carried, "n_words", "spans", "items"])
    return run


def _groups(benchmark: DataFrame, id_col: str, text_col: str, chars: int) -> list[DataFrame]:
    """The benchmark in parts of about ``chars`` characters each, by a hash of the text."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // chars))
    return [items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
         window: int = 10, pattern_chars: int = PATTERN_CHARS) -> DataFrame:
    """``docs`` with n_words, spans (hit word intervals, end exclusive), items (ids with occurring windows, sorted).

    All columns of ``docs`` are carried along; one named like an added column is replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items") or c == text_col]
    carried = [f"c{k}" for k in range(len(kept))]
    rows = small_batches(docs).select(*[column(c).alias(a) for c, a in zip(kept, carried)])
    added = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema] + list(T._parse_datatype_string(added)))
    groups = _groups(benchmark, item_id_col, item_text_col, pattern_chars)
    tables = lambda group: spark.sparkContext.broadcast(Patterns([tuple(r) for r in group.collect()], window))
    if len(groups) == 1:
        found = rows.mapInArrow(_scan(tables(groups[0]), carried, kept.index(text_col)), schema)
    else:
        # Rows are numbered once; a group gives back its hits alone, which are joined at the end.
        text = carried[kept.index(text_col)]
        rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
        hits = None
        for group in groups:
            patterns = tables(group)
            part = written(rows.select("_row", F.col(text).alias("text")).mapInArrow(_hits(patterns), "_row long, spans array<struct<start:long,end:long>>, items array<string>"), "hits")
            patterns.destroy()
            hits = part if hits is None else hits.unionByName(part)
        hits = hits.groupBy("_row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))  # at most one of each group
        found = rows.join(hits, "_row", "left").select(*carried, F.col(text).alias("_text"), "spans", "items").mapInArrow(_merge(carried), schema)
    return found.select(*[F.col(a).alias(c) for c, a in zip(kept, carried)], "n_words", "spans", "items")


def summary(found: DataFrame) -> DataFrame:
    """The digest columns of the contract from the result of :func:`scan`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
