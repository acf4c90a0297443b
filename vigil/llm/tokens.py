"""Token ids in wavelet-matrix files (numbered operator 6).

Documents are dealt by ranges of their id, encoded, and written as shards: Parquet rows that hold the
shard's document ids and lengths, and the bit-planes and rank directories of its wavelet matrix.  A shard
ends at ``shard_tokens`` ids (a document is never split over shards, unless it alone is longer, in which
case it is a shard of its own), so memory is bounded whatever a range holds.

Defined results: a NULL or empty text has the end id alone; rows with equal ids follow each other in the
order of their text; NULL ids come first; an empty table gives no shards.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import column, small_batches
from vigil.llm.encoder import encoder
from vigil.llm.wavelet import WaveletMatrix, build

SHARD = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, alphabet array<long>, zeros array<long>, planes binary, ranks binary"
DOC = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
ENCODE_CHARS = 1 << 20


def _slices(column, chars: int = ENCODE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Texts of an Arrow column in runs of about ``chars`` characters, with the position of the first."""
    run, held, first = [], 0, 0
    for k, text in enumerate(column):
        run.append(text.as_py() or "")
        held += len(run[-1])
        if held >= chars:
            yield first, run
            run, held, first = [], 0, k + 1
    if run:
        yield first, run


def _shards(vocabulary: str, end_id: int, shard_tokens: int, added_tokens: bool):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seq = encoder(vocabulary, added_tokens), 0
        kind = np.uint16 if enc.bits <= 16 else np.uint32
        part, docs, held, lengths, total = None, [], [], [], 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(held)
            held.clear()
            alphabet, zeros, planes, ranks = build(ids)
            row = {"part": part, "seq": seq, "n_tokens": len(ids), "doc_ids": docs, "lengths": lengths, "alphabet": alphabet, "zeros": zeros, "planes": planes, "ranks": ranks}
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for first, texts in _slices(batch.column("text")):
                for k, ids in enumerate(enc.encode(texts), first):
                    if total and total + len(ids) + 1 > shard_tokens:
                        yield shard()
                        seq, docs, held, lengths, total = seq + 1, [], [], [], 0
                    part = batch.column("part")[0].as_py()
                    docs.append(ids_of[k])
                    held.append(np.append(ids, end_id).astype(kind))
                    lengths.append(len(ids) + 1)
                    total += len(ids) + 1
        if total:
            yield shard()
    return make


def write_tokens(docs: DataFrame, path: str, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, end_id: int = 0,
                 shard_chars: int = 16 << 20, shard_tokens: int = 2 << 20, added_tokens: bool = False) -> None:
    """Encode and write every document, in ascending order of ``order_col`` (default: the id); ``shard_chars`` sets how many ranges the table is dealt over.

    Rows that are equal in the order follow each other by id, then text; the rows of one id are split by the beginnings of their texts.
    ``added_tokens``: whether the content of a special token in a text is that token, as in an untouched tokenizer.
    """
    order = column(order_col) if order_col else F.col(id_col).cast("long")
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), order.alias("rank"))
    chars = rows.agg(F.sum(F.length("text") + F.lit(100))).first()[0] or 0
    # The beginning of the text splits the rows of one id over ranges in the same order.
    keys = ["rank", "doc_id", F.substring("text", 1, 64)]
    dealt = rows.repartitionByRange(max(1, -(-int(chars) // shard_chars)), *keys).sortWithinPartitions("rank", "doc_id", "text").drop("rank")
    shards = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(_shards(vocabulary, end_id, shard_tokens, added_tokens), SHARD)
    shards.write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def shard_reader(row) -> WaveletMatrix:
    """Access, counting and occurrence lookup on one row of :func:`read_shards`."""
    return WaveletMatrix(row["n_tokens"], row["alphabet"], list(row["zeros"]), bytes(row["planes"]), bytes(row["ranks"]))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [x.split()[0] for x in DOC.split(", ")], [pa.int32(), pa.int32(), *[pa.int64()] * 4]
    for batch in batches:
        for row in batch.to_pylist():
            data = shard_reader(row).decode()
            ends = np.cumsum(np.array(row["lengths"], np.int64))
            starts = ends - np.array(row["lengths"], np.int64)
            crc = [zlib.crc32(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(crc)
            columns = [np.full(n, row["part"], np.int32), np.full(n, row["seq"], np.int32), row["doc_ids"], starts, row["lengths"], crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    shards = read_shards(spark, path)
    # One narrow row per shard passes the ordered window; documents do not.
    offsets = shards.select("part", "seq", "n_tokens").withColumn(
        "offset", F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).drop("n_tokens")
    docs = shards.mapInArrow(_documents, DOC)
    return docs.join(offsets, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            data = shard_reader(row).decode().astype(np.int32)
            ends = np.cumsum(np.array(row["lengths"], np.int64)).tolist()
            for doc, a, b in zip(row["doc_ids"], [0, *ends], ends):
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([data[a:b]], pa.list_(pa.int32()))], ["doc_id", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and the ids (with the end id) of every document, from the files."""
    return read_shards(spark, path).mapInArrow(_texts, "doc_id long, ids array<int>")
