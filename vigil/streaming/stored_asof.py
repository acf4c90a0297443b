"""As-of enrichment of a stream against a stored operational table, of which a micro-batch reads its own buckets alone.

``store_operational`` lays the table out once by (time bucket, hash of the equipment) and adds, for every bucket and equipment,
the last row before the bucket (``carry``).  What a reading needs then lies in the folders of its own bucket: the rows of the
bucket up to its time, or the carried one.  ``enrich_batch`` names those folders as literal partition filters, so the scan
lists and opens no other file, however large the table is.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.operators.asof import asof_join
from vigil.operators.ordered import join_on_keys, time_bucket

#: A batch that touches more folders than this names its buckets through a join instead of literals.
MOST_FOLDERS = 5_000


def _hash_of(by: str, hashes: int) -> Column:
    return F.pmod(F.xxhash64(F.col(by).cast("string")), F.lit(hashes)).cast("int")


def store_operational(operational: DataFrame, path: str, *, on: str = "timestamp", by: str = "equipment_id", tiebreak: Sequence[str] = (),
                      bucket_seconds: int = 86400, hashes: int = 16) -> None:
    """Writes ``path/rows`` and ``path/carry``, both partitioned by (tb, eh), and ``path/meta``; rows without a time are left out.

    The carried rows are one per equipment and bucket up to the table's last one, and one more bucket for everything later.
    """
    spark = operational.sparkSession
    rows = operational.filter(F.col(on).isNotNull()).withColumns({"tb": time_bucket(F.col(on), bucket_seconds), "eh": _hash_of(by, hashes)})
    rows.hint("rebalance", F.col("tb"), F.col("eh")).write.mode("overwrite").partitionBy("tb", "eh").parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    attrs = [c for c in operational.columns if c not in (on, by)]
    order = F.struct(F.col(on), *[F.col(t) for t in tiebreak])
    last = rows.groupBy(by, "eh", "tb").agg(F.max_by(F.struct(*attrs), order).alias("row"))
    end = rows.agg(F.max("tb")).first()[0]
    if end is None:
        end = 0
    # One row per equipment and bucket from its first one on: the index, not the table, is filled forward.
    spine = last.groupBy(by, "eh").agg(F.min("tb").alias("a")).select(by, "eh", F.explode(F.sequence(F.col("a") + 1, F.lit(end + 1))).alias("tb"))
    known = join_on_keys(spine, last.select(by, "eh", (F.col("tb") + 1).alias("tb"), "row"), [by, "eh", "tb"], "left")
    before = Window.partitionBy(by, "eh").orderBy("tb").rowsBetween(Window.unboundedPreceding, 0)
    carry = known.withColumn("row", F.last("row", ignorenulls=True).over(before)).select(by, "tb", "eh", "row.*")
    carry.hint("rebalance", F.col("tb"), F.col("eh")).write.mode("overwrite").partitionBy("tb", "eh").parquet(f"{path}/carry")
    meta = {"on": on, "by": by, "tiebreak": list(tiebreak), "bucket_seconds": bucket_seconds, "hashes": hashes, "end": end,
            "rows": rows.schema.json(), "carry": carry.schema.json()}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


class StoredOperational:
    """A table written by ``store_operational``."""

    def __init__(self, spark: SparkSession, path: str):
        from pyspark.sql import types as T
        self.spark, self.path = spark, path
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        self.on, self.by, self.tiebreak = meta["on"], meta["by"], meta["tiebreak"]
        self.bucket_seconds, self.hashes, self.end = meta["bucket_seconds"], meta["hashes"], meta["end"]
        self.schemas = {n: T.StructType.fromJson(json.loads(meta[n])) for n in ("rows", "carry")}

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def buckets(self, batch: DataFrame, on: str, by: str) -> DataFrame:
        """(tb, eh) of the folders that a batch needs; times after the table's last bucket share one."""
        tb = F.least(time_bucket(F.col(on), self.bucket_seconds), F.lit(self.end + 1).cast("long"))
        return batch.filter(F.col(on).isNotNull()).select(tb.alias("tb"), _hash_of(by, self.hashes).alias("eh")).distinct()

    def slice_for(self, batch: DataFrame, on: str, by: str) -> DataFrame:
        """The rows of the batch's buckets and the rows carried into them, as the right side of an as-of join."""
        wanted = self.buckets(batch, on, by)
        some = wanted.limit(MOST_FOLDERS + 1).collect()
        folders: dict[int, set[int]] = {}
        for r in some:
            folders.setdefault(r["tb"], set()).add(r["eh"])

        def pruned(df: DataFrame) -> DataFrame:
            if len(some) > MOST_FOLDERS:
                return df.join(wanted, ["tb", "eh"], "left_semi")
            keep = F.lit(False)
            for tb, ehs in folders.items():
                keep = keep | ((F.col("tb") == tb) & F.col("eh").isin(*sorted(ehs)))
            return df.filter(F.col("tb").isin(*sorted(folders)) & keep) if folders else df.limit(0)

        start = F.timestamp_micros(F.col("tb") * F.lit(self.bucket_seconds * 1_000_000))
        carried = pruned(self._table("carry")).withColumns({self.on: start, "_carried": F.lit(0)})
        own = pruned(self._table("rows")).withColumn("_carried", F.lit(1))
        # A carried row stands before the rows at the very start of its bucket.
        return own.unionByName(carried, allowMissingColumns=True).drop("tb", "eh")

    def enrich(self, batch: DataFrame, on: str | None = None, left_tiebreak: Sequence[str] = ()) -> DataFrame:
        """J01 of the batch with the whole table, reading the batch's buckets alone."""
        on = on or self.on
        right = self.slice_for(batch, on, self.by)
        if on != self.on:
            right = right.withColumnRenamed(self.on, on)
        return asof_join(batch, right, on=on, by=[self.by], left_tiebreak=list(left_tiebreak), right_tiebreak=["_carried", *self.tiebreak],
                         bucket_seconds=self.bucket_seconds).drop("_carried")


def asof_enrich_stored(readings: DataFrame, stored: str, sink_path: str, checkpoint: str, left_tiebreak: Sequence[str] = (),
                       trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch joined as-of with the stored table; epoch folders are overwritten by a replay of their batch."""
    spark = readings.sparkSession

    def per_batch(batch: DataFrame, epoch: int) -> None:
        StoredOperational(spark, stored).enrich(batch, left_tiebreak=left_tiebreak).write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch}")

    w = readings.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
