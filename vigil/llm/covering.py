"""SimHash near duplicates by covering locality-sensitive hashing (numbered operator 13).

A fingerprint has 64 bits: one is set where more than half of the XXH64 hashes (seed 42) of the text's word shingles,
repeats included, have it.  Every bit position gets one of the non-zero vectors of radius + 1 bits, and each non-zero
vector v a mask of the positions whose vector has an odd product with v.  For any ``radius`` positions some v is
orthogonal to all their vectors, so two fingerprints that differ there alone agree under the mask of v: every
pair within the radius collides in one of the 2**(radius + 1) - 1 tables (seven for radius 2).

A bucket of two fingerprints is one candidate pair, which its least and greatest member name.  The members of a larger
bucket are not paired: each goes, once, to the fingerprints that differ from it in at most radius/2 bits, and those
that meet there are within the radius of each other and are linked to their least (1 + 64 places each for radius
2; at most 65 fingerprints can meet in one).  So the work is linear in the fingerprints however they crowd.

Links join distinct fingerprints.  Rows of equal fingerprints never meet in one task: they are counted by a partial
aggregate, and fingerprints with many rows find their component through a broadcast of bounded size.

Defined results: a NULL text is empty; a text without words has the fingerprint zero, linked like any other; fewer
than ``k`` words are one shingle; a row with a NULL id has a fingerprint and a component, but never names one (a
component of such rows alone has a NULL name); equal ids are rows of their own; an empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vigil.llm.common import column, fresh, small_batches, written

BITS, SEED = 64, 42
#: Shingle hashes voted on at once (each takes 64 bytes).
VOTES = 1 << 16
#: Keys with more than 1/HEAVY of all rows are joined by broadcast: less than HEAVY keys.
HEAVY = 4096


def fingerprint(text: str | None, k: int = 3) -> int:
    """The 64 bits of one text."""
    words = (text or "").encode().lower().split()  # at ASCII white space; bytes.lower() maps A-Z alone
    if not words:
        return 0
    if len(words) <= k:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    votes, n = np.zeros(BITS, np.int64), len(words) - k + 1
    for first in range(0, n, VOTES):
        last = min(n, first + VOTES)
        starts = [0, *ends[:last - 1]][first:] if first == 0 else ends[first - 1:last - 1]
        hashes = np.array([xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[first + k - 1:last + k - 1])], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def _prints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t.as_py(), k) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(f)], ["id", "f"])
    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """id, f: the fingerprint of every row as a signed long."""
    rows = small_batches(docs).select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    return rows.mapInArrow(_prints(k), "id long, f long")


def masks(radius: int) -> list[int]:
    """The 2**(radius + 1) - 1 masks over 64 positions."""
    top = 1 << (radius + 1)
    return [sum(1 << i for i in range(BITS) if ((i % (top - 1) + 1) & v).bit_count() & 1) for v in range(1, top)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _flips(f: Column, most: int) -> Column:
    """Array of the fingerprints that differ from ``f`` in at most ``most`` bits."""
    out = F.array(f)
    for _ in range(most):
        out = F.array_distinct(F.flatten(F.transform(out, lambda x: F.concat(F.array(x), F.transform(F.array(*[_long(1 << i) for i in range(BITS)]), lambda b: x.bitwiseXOR(b))))))
    return out


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints (column ``f``, each once) that connect all within ``radius`` bits."""
    if radius % 2:
        raise ValueError("an even radius: two fingerprints meet half-way")
    far = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(_long(m)).alias("key")) for t, m in enumerate(masks(radius))])
    rows = prints.select("f", F.inline(tables))
    buckets = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("a"), F.max("f").alias("b")).filter("n > 1")
    buckets = written(buckets, "buckets")
    pairs = buckets.filter("n = 2").filter(far("a", "b") <= radius).select("a", "b")
    crowds = buckets.filter("n > 2").select("t", "key", "n")
    crowded = heavy_join(rows, crowds, ["t", "key"], "n", "left_semi").select("f").distinct()
    places = crowded.select("f", F.explode(_flips(F.col("f"), radius // 2)).alias("place"))
    met = places.groupBy("place").agg(F.min("f").alias("a"), F.collect_list("f").alias("fs")).filter(F.size("fs") > 1)
    stars = met.select("a", F.explode("fs").alias("b")).filter("a <> b")
    return written(pairs.union(stars).distinct(), "links")


def heavy_join(left: DataFrame, side: DataFrame, keys: list[str], count: str, how: str) -> DataFrame:
    """Join ``left`` to ``side`` (unique in the non-NULL ``keys``, how many left rows each has in ``count``) without a hot partition.

    Keys with more than 1/``HEAVY`` of the counted rows (less than ``HEAVY`` of them) are broadcast; the rows of the others are
    dealt by their key.  ``how``: ``left_semi`` or ``left``.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    hot = side.filter(F.col(count) * HEAVY > total)
    flag = fresh(left, "_hot")
    marked = left.join(F.broadcast(hot.select(*keys).withColumn(flag, F.lit(True))), keys, "left")
    first = marked.filter(flag).drop(flag).join(F.broadcast(hot), keys, how)
    rest = marked.filter(F.col(flag).isNull()).drop(flag).join(side.filter(F.col(count) * HEAVY <= total), keys, how)
    return first.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(f, label): the least fingerprint reachable from each end of the links (a, b).

    Each round takes the least label of the neighbours, then that label's own; every round is written to the shared
    folder.  A label that many nodes share is looked up by broadcast.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("f"), F.least("a", "least").alias("label")), "labels")
    while True:
        # A fingerprint has a bounded number of others within the radius, so no node is a hot key here.
        near = both.join(labels.select(F.col("f").alias("b"), "label"), "b").groupBy(F.col("a").alias("f")).agg(F.min("label").alias("seen"))
        step = written(labels.join(near, "f").select("f", F.col("label").alias("old"), F.least("label", "seen").alias("at")), "labels")
        used = step.groupBy("at").agg(F.count(F.lit(1)).alias("n")).join(step.select(F.col("f").alias("at"), F.col("at").alias("next")), "at")
        moved = heavy_join(step, used, ["at"], "n", "left").select("f", F.least("at", "next").alias("label"), (F.least("at", "next") != F.col("old")).alias("moved"))
        moved = written(moved, "labels")
        labels = moved.select("f", "label")
        if not moved.filter("moved").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits), component_id: the least id reachable over links of at most ``radius`` bits."""
    rows = written(fingerprints(docs, id_col=id_col, text_col=text_col, k=k), "fingerprints")
    classes = written(rows.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "classes")
    labels = components(links(classes.select("f"), radius))
    linked = classes.join(labels, "f", "left").withColumn("label", F.coalesce("label", "f"))
    names = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    # A component of many fingerprints is a hot key of this join, one of many rows of the next.
    named = heavy_join(linked, names.filter("m > 1"), ["label"], "m", "left")
    named = written(named.select("f", "n", F.coalesce("component_id", "least").alias("component_id")), "components")
    # Fingerprints of one row keep their own id unless they are linked.
    own = F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint")
    return heavy_join(rows, named, ["f"], "n", "left").select(F.col("id").alias(id_col), own, "component_id")
