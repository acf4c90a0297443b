"""N-gram Jaccard self-join (numbered operator 8): rare-first prefix filtering with length, positional and
suffix filters, each candidate pair verified once on the whole texts.

Frequencies of all shingles of all documents are counted in a table of ``SKETCH_BITS`` hashed counters
(4 MB whatever the input); shingles are ordered by that count, then by their hash, which is one order
for all documents.  Two sets of Jaccard similarity t share a shingle among their first n - ceil(t n) + 1,
and at the first shared one enough shingles must be left in both (positional filter); 64 counts by hash
range bound the intersection from above (suffix filter).

Equal sets are one node.  A shingle's posting list is not expanded into all pairs: first every node meets
the list's head (the node that has the shingle earliest), and links are contracted to components; then only
nodes outside a list's main component meet the others.  A skipped pair is one whose ends are linked already,
so components are exact.

Defined results: texts without words (NULL, empty) have an empty set, linked with nothing; rows with one id
share its component; a NULL id has a NULL component (its row is not a node); an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import at_most, column, columns, fresh, small_batches, without, written
from vigil.llm.covering import heavy_join
from vigil.llm.graph import components
from vigil.llm.shingles import shingle_sets

SKETCH_BITS, CHUNK = 20, 1 << 12
#: Candidate ids are broadcast to thin out the texts while there are at most so many (16 MB); beyond, they are joined.
CANDIDATE_ROWS = 2_000_000
SUMMARY = "id long, digest binary, n long, prefix array<long>, ranges array<int>"


def _bins(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counters of rows (chunk, counts) that arrive in order of their chunk."""
    at, total = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            if chunk != at:
                if at is not None:
                    yield out()
                at, total = chunk, np.zeros(CHUNK, np.int64)
            total += np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
    if at is not None:
        yield out()


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        for batch in batches:
            for _, hashes in shingle_sets(batch.column("text"), k):
                held.append(_bins(hashes))
                size += len(hashes)
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        for chunk in range(len(total) // CHUNK):
            part = total[chunk * CHUNK:(chunk + 1) * CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["chunk", "counts"])
    return run


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Hashed counters of the shingles of all documents (column ``text``); a document counts once per shingle."""
    schema = "chunk int, counts binary"
    parts = docs.select("text").mapInArrow(_count(k), schema).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_sum_chunks, schema)
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in parts.collect():  # 4 MB before compression, whatever the input
        total[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] += np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return np.minimum(total, 2**32 - 1).astype(np.uint32)


def _summaries(shared, k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        counts = shared.value
        for batch in batches:
            digests, sizes, prefixes, ranges = [], [], [], []
            for _, h in shingle_sets(batch.column("text"), k):
                n = len(h)
                rare = np.lexsort((h, counts[_bins(h)]))[:n - -(-num * n // den) + 1] if n else np.zeros(0, np.int64)
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                sizes.append(n)
                prefixes.append(h[rare].view(np.int64))
                ranges.append(np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=64).astype(np.int32))
            columns = [batch.column("id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                       pa.array(prefixes, pa.list_(pa.int64())), pa.array(ranges, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "n", "prefix", "ranges"])
    return run



def _fits(num: int, den: int) -> Column:
    """Length and positional filter of a pair that meets at positions a_pos and b_pos of its prefixes."""
    an, bn, ap, bp = (F.col(c) for c in ("a_n", "b_n", "a_pos", "b_pos"))
    left = F.least(an - ap, bn - bp)
    return (F.least(an, bn) * den >= F.greatest(an, bn) * num) & (left * (num + den) >= (an + bn) * num)


def _verify(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([h for _, h in shingle_sets(batch.column(c), k)] for c in ("a_text", "b_text"))
            keep = []
            for x, y in zip(a, b):
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(den * both >= num * (len(x) + len(y) - both) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])
    return run


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are linked: suffix filter on the range counts, then the whole texts."""
    ranges = nodes.select("id", "n", "ranges")
    wide = pairs.join(ranges.toDF("a", "a_n", "a_ranges"), "a").join(ranges.toDF("b", "b_n", "b_ranges"), "b")
    most = F.aggregate(F.zip_with("a_ranges", "b_ranges", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    pairs = written(wide.filter(most * (num + den) >= (F.col("a_n") + F.col("b_n")) * num).select("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    if at_most(ids, CANDIDATE_ROWS):
        ids = F.broadcast(ids)
    # A node's text is that of its own id and digest; rows that repeat it count once.
    texts = docs.join(ids, "id", "left_semi").dropDuplicates(["id", "text"])
    wide = pairs.join(texts.toDF("a", "a_text"), "a").join(texts.toDF("b", "b_text"), "b")
    return written(wide.mapInArrow(_verify(k, num, den), "a long, b long").distinct(), "links")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """id, n_shingles, component_id for every row: links where intersection / union >= num / den."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = spark.sparkContext.broadcast(frequencies(rows, k))
    summary = written(rows.mapInArrow(_summaries(counts, k, num, den), SUMMARY), "summary")
    # Equal sets are one node, named by the smallest id; only narrow rows are grouped.
    known = summary.filter("n > 0 AND id IS NOT NULL")
    classes = known.groupBy("digest", "n").agg(F.min("id").alias("node"))
    nodes = known.join(classes.withColumnRenamed("node", "id"), ["digest", "n", "id"], "left_semi").dropDuplicates(["id", "digest"])
    tokens = nodes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    shared_tokens = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    postings = written(tokens.join(shared_tokens, "token"), "postings")
    # First every node meets the head of each of its lists.
    heads = postings.groupBy("token").agg(F.min(F.struct("pos", "n", "id")).alias("h")).select("token", F.col("h.id").alias("a"), F.col("h.n").alias("a_n"), F.col("h.pos").alias("a_pos"))
    met = postings.select("token", F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos")).join(heads, "token")
    met = met.filter("a <> b").filter(_fits(num, den)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = written(met, "met")
    first = _links(met, nodes, rows, k, num, den)
    labels = components(first)
    # Then nodes outside the main component of a list meet the others.
    placed = postings.join(labels.toDF("id", "label"), "id", "left").select("token", "id", "n", "pos", F.coalesce("label", "id").alias("label"))
    sizes = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("parts"))
    mixed = written(placed.join(sizes.filter("parts > 1").select("token", "main"), "token"), "mixed")
    side = lambda p, d: d.select("token", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "n", "pos", "label", "main")])
    out, all_ = side("a", mixed.filter("label <> main")), side("b", mixed).drop("b_main")
    rest = out.join(all_, "token").filter(F.col("a_label") != F.col("b_label"))
    rest = rest.filter((F.col("b_label") == F.col("a_main")) | (F.col("a_id") < F.col("b_id"))).filter(_fits(num, den))
    rest = rest.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct().join(met, ["a", "b"], "left_anti")
    second = _links(rest, nodes, rows, k, num, den)
    # Rows that share an id are one document, whatever their texts.
    own = known.select("id", "digest", "n").distinct().join(classes, ["digest", "n"]).select("id", "node")
    several = own.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("id", "a")
    same = own.join(several, "id").filter("a <> node").select("a", F.col("node").alias("b"))
    labels = components(first.union(second).union(same))
    named = classes.join(labels.toDF("node", "label"), "node", "left").select("digest", "n", F.coalesce("label", "node").alias("component"))
    found = summary.select("id", "digest", "n").join(named, ["digest", "n"], "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` of which each group of links keeps one: that with the smallest id (NULL ids last).

    A node is an id and its text, so different texts under one id, or under no id, are documents of their own; of rows that
    repeat both one stays.
    """
    node, spare = fresh(docs, "_node"), fresh(docs, "_row")
    keyed = docs.withColumn(node, F.xxhash64(column(id_col), column(text_col)))
    found = join(keyed, id_col=node, text_col=text_col, k=k, num=num, den=den).select(column(node).alias("node"), "component_id")
    # One row per node; the partial aggregates take rows that repeat an id and text.
    found = found.groupBy("node").agg(F.min("component_id").alias("component"))
    nodes = keyed.select(column(node).alias("node"), column(id_col).alias("id")).groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    nodes = written(nodes.join(found, "node"), "components")
    first = nodes.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("first"))
    groups = first.join(nodes.groupBy("component").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "component").select("component", F.col("first.node").alias("best"), "c")
    lost = written(heavy_join(nodes, groups, ["component"], "c", "left").filter("best <> node").select(F.col("node").alias(node)), "lost")
    kept = without(keyed, lost, [node])
    repeated = nodes.filter("rows > 1").select(F.col("node").alias(node))
    if not repeated.limit(1).count():
        return kept.drop(node)
    # Only the rows that repeat an id and text are aggregated: the least by a hash of the whole row.
    single = without(kept, repeated, [node]).drop(node)
    twin = fresh(keyed, "_twin")
    again = kept.join(repeated.withColumnRenamed(node, twin), column(node) == column(twin), "left_semi")
    again = again.groupBy(column(node)).agg(F.min_by(F.struct(*columns(docs)), F.xxhash64(*columns(docs))).alias(spare))
    return single.unionByName(again.select(f"{spare}.*"))
