"""Streams whose state crosses micro-batches: rows may come out of order, and late rows are told apart.

* ``cooldown_reordered`` (T04): the W07 fold on a stream that is out of order by up to its watermark delay.  Equipment is dealt
  by hash over a fixed number of buckets, so that a micro-batch makes one call and a few state reads per bucket, however many machines
  there are.  A bucket has a value state (series start and last emission of each of its machines) and a list state that holds
  triggered rows back, one entry a micro-batch; an event-time timer releases them, in time order, once the watermark has
  passed them.  Rows within the gap of the last emission are never held, so the list state is bounded by the delay.
* ``alert_fan_out`` (T02): one source, one query and one watermark feed the immediate list, hourly digests and daily digests.
  Windows are closed by Spark's stateful aggregation; alerts whose window was closed before they came go to a table of late rows.
* ``rolling_closed`` (T05): sliding-window statistics in append mode, with the rows that Spark drops as late counted.

Times are compared in UTC microseconds inside the state, so the session time zone plays no part.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from vigil.functions import rules as R
from vigil.operators.quality import exceeding_readings
from vigil.streaming.jobs import sliding_windows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COOLDOWN_OUT = "equipment_id string, t long, event_id long, failing boolean"
FOLD = "equipment array<string>, start array<long>, last array<long>"
HELD = "owner array<int>, t array<long>, event_id array<long>, failing array<boolean>"
#: Buckets of equipment in the state of ``cooldown_reordered``; a checkpoint keeps those it began with.
COOLDOWN_BUCKETS = 512
#: A start later and a last emission earlier than any time, and the id of a row without one.
NO_START, NO_LAST, NO_ID = 1 << 62, -(1 << 62), -(1 << 63)


def use_rocks(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB; sets the session's provider where it is another."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, "") != ROCKS:
        spark.conf.set(key, ROCKS)


class Cooldown(StatefulProcessor):
    """The W07 folds of one bucket of equipment behind the watermark."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", FOLD)
        self.held = handle.getListState("held", HELD)

    def _wait(self, t: int) -> None:
        """Wakes up when the watermark has passed the time."""
        self.handle.registerTimer(-(-t // 1000))

    def _folds(self) -> tuple[list, np.ndarray, np.ndarray]:
        """The bucket's equipment, and the series start and last emission of each."""
        names, start, last = self.fold.get() if self.fold.exists() else ([], [], [])
        return list(names), np.array(start, np.int64), np.array(last, np.int64)

    def _hold(self, rows: Sequence[np.ndarray]) -> tuple[list, ...]:
        return tuple(column.tolist() for column in rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, start, last = self._folds()
        place = {name: k for k, name in enumerate(names)}
        parts = []
        for frame in rows:
            codes, found = pd.factorize(frame["equipment_id"], use_na_sentinel=False)
            owner = np.array([place.setdefault(None if pd.isna(name) else name, len(place)) for name in found], np.int64)[codes]
            new = len(place) - len(start)
            start, last = np.append(start, np.full(new, NO_START)), np.append(last, np.full(new, NO_LAST))
            t = frame["t"].to_numpy(np.int64)
            # Nothing at or before the watermark can come any more, so a start is final before a row is released.
            np.minimum.at(start, owner, t)
            hot = frame["triggered"].to_numpy(bool) & (t > last[owner] + self.gap)
            if hot.any():
                parts.append((owner[hot], t[hot], frame["event_id"].to_numpy(np.int64)[hot], frame["failing"].to_numpy(bool)[hot]))
        self.fold.update((list(place), start.tolist(), last.tolist()))
        if parts:
            held = [np.concatenate(column) for column in zip(*parts)]
            self.held.appendValue(self._hold(held))
            self._wait(int(held[1].min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        parts = list(self.held.get()) if self.held.exists() else []
        if not parts:
            return
        held = [np.concatenate([np.array(part[k], kind) for part in parts]) for k, kind in enumerate((np.int64, np.int64, np.int64, bool))]
        if held[1].min() > passed:  # another timer of the batch has released all that could be
            self._wait(int(held[1].min()))
            return
        names, start, last = self._folds()
        free = held[1] <= passed
        owner, t, event, failing = (column[free] for column in held)
        order = np.lexsort((failing, event, t, owner))
        owner, t, event, failing = owner[order], t[order], event[order], failing[order]
        times, emitted = t.tolist(), []
        edges = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(times)]
        for low, high in zip(edges, edges[1:]):
            machine = owner[low]
            since = int(start[machine] if last[machine] == NO_LAST else last[machine])
            # one step per emission: the first triggered row later than the last emission plus the gap
            at = bisect_right(times, since + self.gap, low, high)
            while at < high:
                emitted.append(at)
                last[machine] = times[at]
                at = bisect_right(times, times[at] + self.gap, at, high)
        waiting = ~free & (held[1] > last[held[0]] + self.gap)
        self.fold.update((names, start.tolist(), last.tolist()))
        if waiting.any():
            self.held.put([self._hold([column[waiting] for column in held])])
            self._wait(int(held[1][waiting].min()))
        else:
            self.held.clear()
        if emitted:
            yield pd.DataFrame({"equipment_id": pd.Series([names[k] for k in owner[emitted]], dtype=object), "t": t[emitted],
                                "event_id": event[emitted], "failing": failing[emitted]})

    def close(self) -> None:
        pass


def cooldown_reordered(readings: DataFrame, threshold: float = 0.8, gap_seconds: int = 30 * 24 * 3600,
                       trigger_col: str = "degradation_level", flag_col: str = "failure_imminent", watermark: str = "1 day",
                       buckets: int = COOLDOWN_BUCKETS) -> DataFrame:
    """equipment_id, timestamp, event_id, maintenance_type of the rows that the cooldown rule emits, in any order of arrival.

    Equal to ``series.cooldown_events`` over all rows that are not behind the watermark when they come.  A row is
    emitted when the watermark has passed it.  Ties in time go by ``event_id``.  The state is kept by bucket of equipment;
    ``buckets`` bounds the calls of a micro-batch and must stay the same over a checkpoint's life.
    """
    use_rocks(readings.sparkSession)
    src = readings.select("equipment_id", "timestamp", F.unix_micros("timestamp").alias("t"),
                          F.coalesce(F.col("event_id").cast("long"), F.lit(NO_ID)).alias("event_id"),
                          F.coalesce(F.col(trigger_col) > threshold, F.lit(False)).alias("triggered"),
                          F.coalesce(F.col(flag_col).cast("boolean"), F.lit(False)).alias("failing"),
                          F.pmod(F.xxhash64("equipment_id"), F.lit(buckets)).cast("int").alias("bucket"))
    out = src.filter(F.col("t").isNotNull()).withWatermark("timestamp", watermark).groupBy("bucket").transformWithStateInPandas(
        Cooldown(gap_seconds * 1_000_000), COOLDOWN_OUT, "append", "eventTime")
    kind = F.when(F.col("failing"), F.lit("corrective")).otherwise(F.lit("preventive"))
    return out.select("equipment_id", F.timestamp_micros("t").alias("timestamp"),
                      F.nullif("event_id", F.lit(NO_ID)).alias("event_id"), kind.alias("maintenance_type"))


def rolling_closed(readings: DataFrame, columns: Sequence[str], path: str, checkpoint: str, length: str = "8 hours", slide: str = "1 hour",
                   watermark: str = "1 hour", ts: str = "timestamp", by: str = "equipment_id", trigger: dict | None = None) -> StreamingQuery:
    """Writes the statistics of every sliding window once, when the watermark closes it; state of closed windows is evicted."""
    windows = sliding_windows(readings.withWatermark(ts, watermark), columns, length, slide, ts, by)
    flat = windows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in windows.columns if c != "window"])
    w = flat.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return w.trigger(**(trigger or {"availableNow": True})).start()


def dropped_late(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators dropped because they came behind the watermark, after pre-aggregation in their batch."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def closed_before(spark: SparkSession, checkpoint: str, epoch: int) -> int:
    """The watermark, in milliseconds, that a batch's rows are late against: that of the batch before, from the offset log."""
    if epoch < 1:
        return 0
    lines = spark.read.text(f"{checkpoint}/offsets/{epoch - 1}").collect()  # three short lines
    return next((json.loads(r[0])["batchWatermarkMs"] for r in lines if "batchWatermarkMs" in r[0]), 0)


ALERT_KINDS = {"hourly": "1 hour", "daily": "1 day"}


def alert_fan_out(readings: DataFrame, path: str, checkpoint: str, thresholds: Mapping[str, float] = R.ALERT_THRESHOLDS,
                  watermark: str = "1 hour", kinds: Mapping[str, str] = ALERT_KINDS, tiebreak: str = "event_id",
                  ts: str = "timestamp", by: str = "equipment_id", trigger: dict | None = None) -> StreamingQuery:
    """Writes below ``path`` the tables ``immediate``, one per window kind, and ``late``, by epoch.

    immediate: every alert as it comes.  A digest: window_start, equipment, sensor, n, max_value, once the watermark has
    closed the window.  late: kind and alert for each alert that came after its window of that kind was closed and is
    missing from that digest.  A replayed epoch overwrites its own folder.
    """
    spark = readings.sparkSession
    rows = readings.withWatermark(ts, watermark)
    hot = exceeding_readings(rows, {s: v for s, v in thresholds.items() if s in readings.columns}, [tiebreak, by, ts])
    names = ["kind", "at", by, "sensor", tiebreak, "n", "value"]
    streams = [hot.select(F.lit("immediate").alias("kind"), F.col(ts).alias("at"), by, "sensor", F.col(tiebreak).cast("long").alias(tiebreak),
                          F.lit(1).cast("long").alias("n"), "value")]
    for kind, width in kinds.items():
        digest = hot.groupBy(F.window(ts, width).alias("w"), by, "sensor").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))
        streams.append(digest.select(F.lit(kind).alias("kind"), F.col("w.start").alias("at"), by, "sensor", F.lit(None).cast("long").alias(tiebreak), "n", "value"))
    every = streams[0]
    for s in streams[1:]:
        every = every.unionByName(s)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.select(*names).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/digests/epoch={epoch}")
        came = spark.read.schema(batch.select(*names).schema).parquet(f"{path}/digests/epoch={epoch}").filter("kind = 'immediate'")
        closed = F.timestamp_millis(F.lit(closed_before(spark, checkpoint, epoch)))
        missed = None
        for kind, width in kinds.items():
            part = came.withColumn("w", F.window("at", width)).filter(F.col("w.end") <= closed)
            part = part.select(F.lit(kind).alias("kind"), F.col("at").alias(ts), by, "sensor", tiebreak, "value")
            missed = part if missed is None else missed.unionByName(part)
        missed.write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")

    w = every.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return w.trigger(**(trigger or {"availableNow": True})).start()


def digests(spark: SparkSession, path: str, kind: str, by: str = "equipment_id") -> DataFrame:
    """One table of ``alert_fan_out``: all epochs of ``immediate``, of a window kind, or of ``late``."""
    if kind == "late":
        return spark.read.parquet(f"{path}/late").drop("epoch")
    rows = spark.read.parquet(f"{path}/digests").filter(F.col("kind") == kind).drop("kind", "epoch")
    if kind == "immediate":
        return rows.drop("n").withColumnRenamed("at", "timestamp")
    return rows.select(F.col("at").alias("window_start"), by, "sensor", "n", F.col("value").alias("max_value"))
