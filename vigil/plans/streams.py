"""Registered queries of streams over many micro-batches, with rows out of order and rows behind the watermark.

The events are dealt by time into ``CHUNKS`` chunks, one micro-batch each.  Every seventh event comes one chunk late, which is
within the watermark's delay of two chunks; every 101st of the first five chunks comes with the last one, far behind it.  The
SQL of each query leaves those rows out, so a query is right only if its state carries over batches, waits for rows out
of order, and drops the late ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import rules as R
from vigil.plans.readings import event_readings
from vigil.plans.util import finish
from vigil.session import ensure_checkpoint_dir
from vigil.sources.tables import read_table
from vigil.streaming import stateful, stored_asof

CHUNKS, FILES = 10, 2
FILE_ROWS = 250_000
LATE_EVERY, LATE_CHUNKS, SHIFT_EVERY = 101, 5, 7
END = "~end"  # an equipment whose far later readings let the watermark pass all others


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _span(df: DataFrame) -> tuple[int, int, int]:
    """Least and greatest time, in microseconds, and the number of rows."""
    return tuple(df.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp")), F.count(F.lit(1))).first())


def _files(spark, path: str) -> int:
    """Parquet files in a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return sum(f.getPath().getName().startswith("part-") for f in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop))


def feed(spark, df: DataFrame, name: str, late: bool = True) -> tuple[DataFrame, str]:
    """(stream, delay): ``df`` as files in order of arrival, as many a micro-batch, and a watermark delay of two chunks.

    A chunk has ``FILES`` files, or more where chunks average more than ``FILE_ROWS`` rows a file; one with too few rows for
    them gets empty files, so that a micro-batch is always one chunk.
    """
    low, high, n = _span(df)
    files = max(FILES, -(-n // (CHUNKS * FILE_ROWS)))
    chunk = F.expr(f"cast((unix_micros(timestamp) - {low}) * {CHUNKS} div {high - low + 1} as int)")
    at = F.when(F.col("event_id") % SHIFT_EVERY == 0, F.least(chunk + 1, F.lit(CHUNKS - 1))).otherwise(chunk)
    if late:
        at = F.when((F.col("event_id") % LATE_EVERY == 0) & (chunk < LATE_CHUNKS), F.lit(CHUNKS - 1)).otherwise(at)
    path = _folder(spark, name)
    last = F.timestamp_micros(F.lit(high + 100 * 86400 * 1_000_000))
    types = dict(df.dtypes)
    empty = [F.lit(END).alias(c) if c == "equipment_id" else last.alias(c) if c == "timestamp" else F.lit(None).cast(types[c]).alias(c) for c in df.columns]
    for k in range(CHUNKS):
        df.filter(at == k).repartition(files).write.mode("append").parquet(path)
        for _ in range((k + 1) * files - _files(spark, path)):
            spark.range(0, numPartitions=1).select(*empty).write.mode("append").parquet(path)
    spark.range(files, numPartitions=files).select(*empty).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream, f"{-(-2 * (high - low) // (CHUNKS * 1_000_000))} seconds"


def _cooldown(spark, sf_dir: str, late: bool) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"]).select(
        "event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"),
        F.col("value").alias("degradation_level"), (F.col("event_type") == "error").alias("failure_imminent"))
    stream, delay = feed(spark, ev, "cooldown-batches", late)
    out = stateful.cooldown_reordered(stream, 20.0, 5 * 24 * 3600, watermark=delay)
    path = _folder(spark, "cooldown-out")
    (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", _folder(spark, "cooldown-checkpoint"))
        .trigger(availableNow=True).start().awaitTermination())
    return finish(spark.read.schema(out.schema).parquet(path))


def q_cooldown_batches(spark, sf_dir):
    """The cooldown fold on a stream of ten micro-batches, rows out of order, none behind the watermark."""
    return _cooldown(spark, sf_dir, late=False)


def q_cooldown_late(spark, sf_dir):
    """T04 with rows behind the watermark: the fold of all rows that come in time."""
    return _cooldown(spark, sf_dir, late=True)


def q_rolling_batches(spark, sf_dir):
    """Sliding-window statistics over ten micro-batches, each window written when it closes; and the dropped late rows."""
    rd = event_readings(spark, sf_dir, with_degradation=False).select("event_id", "timestamp", "equipment_id", "temperature")
    stream, delay = feed(spark, rd, "rolling-batches")
    path = _folder(spark, "rolling-out")
    query = stateful.rolling_closed(stream, ["temperature"], path, _folder(spark, "rolling-checkpoint"), "8 hours", "4 hours", delay)
    query.awaitTermination()
    out = spark.read.parquet(path).select("window_start", "equipment_id", "temperature_mean", "temperature_min", "temperature_max", "n")
    late = spark.range(1).select(F.lit(None).cast("timestamp").alias("window_start"), F.lit("late").alias("equipment_id"), *[
        F.lit(None).cast("double").alias(f"temperature_{c}") for c in ("mean", "min", "max")], F.lit(stateful.dropped_late(query)).cast("long").alias("n"))
    return finish(out.unionByName(late))


def q_alert_batches(spark, sf_dir):
    """Immediate alerts, hourly and daily digests and late alerts of one stream of ten micro-batches."""
    rd = event_readings(spark, sf_dir, with_degradation=False).select("event_id", "timestamp", "equipment_id", "temperature", "vibration", "tool_wear")
    stream, delay = feed(spark, rd, "alert-batches")
    path = _folder(spark, "alerts")
    thresholds = {s: R.ALERT_THRESHOLDS[s] for s in ("temperature", "vibration", "tool_wear")}
    stateful.alert_fan_out(stream, path, _folder(spark, "alerts-checkpoint"), thresholds, delay).awaitTermination()
    cols = ["kind", "at", "equipment_id", "sensor", "event_id", "n", "max_value"]
    one, none = F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("event_id")
    now = stateful.digests(spark, path, "immediate").select(F.lit("immediate").alias("kind"), F.col("timestamp").alias("at"), "equipment_id", "sensor", "event_id", one, F.col("value").alias("max_value"))
    late = stateful.digests(spark, path, "late").select(F.concat(F.lit("late "), "kind").alias("kind"), F.col("timestamp").alias("at"), "equipment_id", "sensor", "event_id", one, F.col("value").alias("max_value"))
    out = now.unionByName(late)
    for kind in stateful.ALERT_KINDS:
        out = out.unionByName(stateful.digests(spark, path, kind).select(F.lit(kind).alias("kind"), F.col("window_start").alias("at"), "equipment_id", "sensor", none, "n", "max_value"))
    return finish(out.select(*cols))


def q_asof_batches(spark, sf_dir):
    """The as-of join of ten micro-batches against the stored operational table, each reading its own buckets."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    left = ev.filter("event_type <> 'view'").select("event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"), "value")
    right = ev.filter("event_type = 'view'").select(F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"),
                                                    F.col("event_id").alias("view_event_id"), F.col("value").alias("view_value"))
    stored = _folder(spark, "operational")
    stored_asof.store_operational(right, stored, tiebreak=["view_event_id"], bucket_seconds=3 * 86400, hashes=4)
    stream, _ = feed(spark, left, "asof-batches")
    path = _folder(spark, "asof-out")
    stored_asof.asof_enrich_stored(stream, stored, path, _folder(spark, "asof-checkpoint"), left_tiebreak=["event_id"]).awaitTermination()
    out = spark.read.parquet(path).filter(F.col("equipment_id") != END)
    return finish(out.select("event_id", "timestamp", "equipment_id", "value", F.col("view_event_id").cast("string").alias("view_event_id"), "view_value"))


def queries() -> dict:
    return {f.__name__[2:]: f for f in (q_cooldown_batches, q_cooldown_late, q_rolling_batches, q_alert_batches, q_asof_batches)}


# --- SQL --------------------------------------------------------------------------

_CHUNK = f"""edge AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
came AS (SELECT e.*, (epoch_us(ts) - lo) * {CHUNKS} // (hi - lo + 1) AS chunk FROM events e, edge),
parted AS (SELECT *, event_id % {LATE_EVERY} = 0 AND chunk < {LATE_CHUNKS} AS late FROM came)"""


def _cooldown_sql(where: str) -> str:
    return f"""
WITH RECURSIVE {_CHUNK},
rd AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS e, event_type = 'error' AS failing, value FROM parted WHERE {where}),
c AS (SELECT * FROM rd WHERE value > 20.0),
st AS (SELECT e, min(ts) + INTERVAL 5 DAY AS probe FROM rd GROUP BY 1),
first_e AS (SELECT arg_min(c.event_id, c.ts) AS event_id FROM st JOIN c ON st.e = c.e AND c.ts > probe GROUP BY st.e),
nx AS (SELECT a.event_id, arg_min(b.event_id, b.ts) AS nxt FROM c a JOIN c b ON a.e = b.e AND b.ts > a.ts + INTERVAL 5 DAY GROUP BY a.event_id),
chain(event_id) AS (SELECT event_id FROM first_e UNION ALL SELECT nx.nxt FROM chain JOIN nx ON nx.event_id = chain.event_id)
SELECT c.e AS equipment_id, c.ts AS "timestamp", c.event_id, CASE WHEN failing THEN 'corrective' ELSE 'preventive' END AS maintenance_type FROM chain JOIN c USING (event_id)"""


def oracle_sql() -> dict[str, str]:
    from vigil.plans.oracle import _ev
    rd = "WITH " + _ev()
    windows = """unnest([time_bucket(INTERVAL 4 HOUR, "timestamp"), time_bucket(INTERVAL 4 HOUR, "timestamp") - INTERVAL 4 HOUR])"""
    late = f"""SELECT event_id FROM parted WHERE late"""
    return {
        "cooldown_batches": _cooldown_sql("true"),
        "cooldown_late": _cooldown_sql("NOT late"),
        "rolling_batches": f"""{rd}, {_CHUNK},
x AS (SELECT event_id, equipment_id, temperature, {windows} AS window_start FROM rd)
SELECT window_start, equipment_id, round(avg(temperature), 6) AS temperature_mean, round(min(temperature), 6) AS temperature_min, round(max(temperature), 6) AS temperature_max, count(*) AS n
FROM x WHERE event_id NOT IN ({late}) GROUP BY 1, 2
UNION ALL SELECT NULL, 'late', NULL, NULL, NULL, count(DISTINCT (window_start, equipment_id)) FROM x WHERE event_id IN ({late})""",
        "alert_batches": f"""{rd}, {_CHUNK},
l AS (SELECT event_id, "timestamp", equipment_id, 'temperature' AS sensor, temperature AS value, 314.0 AS t FROM rd UNION ALL
  SELECT event_id, "timestamp", equipment_id, 'vibration', vibration, 3.06 FROM rd UNION ALL SELECT event_id, "timestamp", equipment_id, 'tool_wear', tool_wear, 250.0 FROM rd),
hot AS (SELECT *, event_id IN ({late}) AS late FROM l WHERE value > t)
SELECT 'immediate' AS kind, "timestamp" AS "at", equipment_id, sensor, event_id, CAST(1 AS BIGINT) AS n, round(value, 6) AS max_value FROM hot
UNION ALL SELECT kind, date_trunc(unit, "timestamp"), equipment_id, sensor, NULL, count(*), round(max(value), 6)
  FROM hot, (VALUES ('hourly', 'hour'), ('daily', 'day')) k(kind, unit) WHERE NOT late GROUP BY 1, 2, 3, 4
UNION ALL SELECT 'late ' || kind, "timestamp", equipment_id, sensor, event_id, CAST(1 AS BIGINT), round(value, 6) FROM hot, (VALUES ('hourly'), ('daily')) k(kind) WHERE late""",
        "asof_batches": """
WITH l AS (SELECT event_id, ts, user_id, value FROM events WHERE event_type <> 'view'),
v AS (SELECT event_id AS vid, ts AS vts, user_id, value AS vv FROM events WHERE event_type = 'view')
SELECT l.event_id, l.ts AS "timestamp", CAST(l.user_id AS VARCHAR) AS equipment_id, round(l.value, 6) AS value, CAST(v.vid AS VARCHAR) AS view_event_id, round(v.vv, 6) AS view_value
FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts >= v.vts""",
    }
