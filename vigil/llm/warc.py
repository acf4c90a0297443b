"""Content-addressed web archive in WARC 1.1 files (numbered operator 9).

Payload bytes are stored once per SHA-256 digest, in the record of the smallest id that has them
(``response``).  Every other record with that payload is a ``revisit``: its exact header block is kept,
its payload is found again by a join on the digest.  Payloads below ``min_bytes`` are always stored in
place.  Files are written and read by Spark alone, so they may lie in any store that it reaches.

Defined results: a NULL payload is the empty payload; a NULL id is kept as an empty record id and
is always a response; rows that repeat the id of a response are responses too; equal payloads are found
whatever their size; an empty table gives an empty archive.  Columns other than the named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "id string, record_type string, refers_to string, payload_digest string, payload_bytes long, headers string, payload binary"
EOL = "\r\n"


def _one_line(c):
    """Header values hold no line breaks: percent-encode them (and the percent sign before CR/LF codes stays as it is)."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(records: DataFrame, path: str, *, id_col: str, uri_col: str, payload_col: str,
                  headers_col: str | None = None, min_bytes: int = 100, records_per_file: int = 20_000,
                  file_bytes: int = 128 << 20, date: str = "1970-01-01T00:00:00Z", date_col: str | None = None) -> None:
    """Write one WARC record per row of ``records`` below ``path`` (``responses/`` and ``revisits/``).

    ``headers_col`` holds further header lines (each ended by CRLF), which are kept exactly.  ``date_col`` is the time of
    capture (UTC); ``date`` stands for rows without one.  Records are dealt by a hash over as many files as give each about
    ``file_bytes`` of payload before compression, and at most ``records_per_file`` records.
    """
    payload = F.col(payload_col)
    if dict(records.dtypes)[payload_col] != "binary":
        payload = F.encode(payload.cast("string"), "UTF-8")
    rows = records.select(
        F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("rank"), F.col(uri_col).cast("string").alias("uri"),
        (F.col(headers_col) if headers_col else F.lit("")).alias("extra"),
        F.coalesce(F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string"), F.lit(date)).alias("date"), F.coalesce(payload, F.lit(b"")).alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    keys = rows.select("rank", "digest", "n").filter((F.col("n") >= min_bytes) & F.col("rank").isNotNull())
    # One small row per payload that several ids share; map-side partial aggregates take a hot payload.
    first = keys.groupBy("digest", "n").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).filter("first <> last").select("digest", "n", "first")
    revisits = keys.join(first, ["digest", "n"]).filter("rank <> first").select("rank", "digest", F.col("first").cast("string").alias("refers_to")).distinct()
    # The payload moves once, dealt by record id and digest: a payload with a third of all rows is spread.
    size = records.agg(F.sum(F.octet_length(payload).cast("long") + 500)).first()[0] or 0
    parts = max(-(-int(size) // file_bytes), int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")) if size > file_bytes else 1)
    rows = rows.repartition(parts, "rank", "digest").join(revisits, ["rank", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:record:"), F.coalesce(_one_line(F.col("id")), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("uri"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:record:"), F.col("refers_to"), F.lit(">")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n"))),
    ]
    head = F.concat(F.concat_ws(EOL, *lines), F.lit(EOL), F.coalesce("extra", F.lit("")), F.lit(EOL))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    out = rows.select(F.concat(head, body).alias("value"), F.when(revisit, "revisits").otherwise("responses").alias("part"))
    (out.write.partitionBy("part").option("lineSep", EOL * 2).option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).text(path))


_FIELD = {k: re.compile(rb"\r\n" + k + rb": ([^\r]*)") for k in (b"WARC-Type", b"WARC-Payload-Digest", b"Content-Length")}
_URN = {k: re.compile(rb"\r\n" + k + rb": <(?:urn:record:)?([^\r]*)>") for k in (b"WARC-Record-ID", b"WARC-Refers-To")}


def inflated(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file, all its members in order, in pieces; raises where a member is cut short."""
    view, at = memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(view) and not member.unconsumed_tail:
                raise ValueError("gzip member without its end")
            fed = member.unconsumed_tail or view[at:at + piece]
            at += 0 if member.unconsumed_tail else len(fed)
            if out := member.decompress(fed, piece):
                yield out
        at -= len(member.unused_data)
        while at < len(view) and not view[at]:  # padding between members
            at += 1


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """The records of one WARC file given in pieces; raises where the stored payload does not have the stated digest.

    Record types other than response and revisit (those of foreign writers: warcinfo, request, metadata) are passed over.
    """
    held, ended = bytearray(), False

    def fill(n: int) -> bool:
        """Whether the next n bytes are there."""
        nonlocal ended
        while len(held) < n and not ended:
            more = next(pieces, None)
            ended = more is None
            held.extend(more or b"")
        return len(held) >= n

    pieces = iter(pieces)
    while fill(1):
        stop, looked = -1, 0
        while stop < 0:
            stop = held.find(b"\r\n\r\n", max(0, looked - 3))
            looked = len(held)
            if stop < 0 and not fill(looked + 1):
                raise ValueError("record header without its end")
        stop += 4
        head = bytes(held[:stop])
        get = lambda table, k: m[1].decode() if (m := table[k].search(head)) else None
        size = int(get(_FIELD, b"Content-Length"))
        if not fill(stop + size + 4) or held[stop + size:stop + size + 4] != b"\r\n\r\n":
            raise ValueError("record without its end mark")
        payload, digest, kind = bytes(held[stop:stop + size]), get(_FIELD, b"WARC-Payload-Digest"), get(_FIELD, b"WARC-Type")
        del held[:stop + size + 4]
        if kind not in ("response", "revisit"):
            continue
        if digest is not None and digest.startswith("sha256:"):
            digest = digest.removeprefix("sha256:")
            if len(digest) == 56:  # base 32, as some writers have it
                digest = base64.b32decode(digest.upper()).hex()
            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of record {get(_URN, b'WARC-Record-ID')} does not have its digest")
        elif digest is None:  # other digests stay as they are stated
            digest = hashlib.sha256(payload).hexdigest()
        yield get(_URN, b"WARC-Record-ID") or None, kind, get(_URN, b"WARC-Refers-To"), digest, size, head.decode(), payload


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for data in batch.column("content"):
            rows, held = [], 0
            for record in parse_records(inflated(data.as_py())):
                rows.append(record)
                held += record[4] + 500
                if held > 8 << 20:  # hand over in bounded batches
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record as stored: id, record_type, refers_to, payload_digest, payload_bytes (stored), headers, payload (stored)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_parse_files, RECORD)


def restore(records: DataFrame, columns: tuple[str, ...] = ("payload",)) -> DataFrame:
    """The original records: revisits take ``columns`` of the response with their digest and id by a join.

    The digest of each stored payload was checked when its file was read.  A revisit whose response is not there raises.
    """
    own = records.filter("record_type = 'response'")
    again = records.filter("record_type = 'revisit'").drop(*columns)
    store = own.select("payload_digest", F.col("id").alias("refers_to"), F.lit(True).alias("_stored"), *columns).dropDuplicates(["payload_digest", "refers_to"])
    found = again.join(store, ["payload_digest", "refers_to"], "left")
    lost = F.raise_error(F.concat(F.lit("no response for revisit "), F.coalesce("id", F.lit("without id")))).cast("boolean")
    found = found.filter(F.when(F.col("_stored"), F.lit(True)).otherwise(lost)).drop("_stored")
    return own.unionByName(found).select(records.columns)
