"""Structured Streaming jobs.

The reference has no streaming code; its one "online" path scores one HTTP
request at a time.  These jobs re-aim that logic at streams with the same
row-level functions the batch path uses (``rules``, ``quality.validate_ranges``,
``ml.predict``), so batch and stream give identical answers per row.

* T01 ``scoring_stream``: stateless validate + score.
* T02 ``alert_digest_stream``: readings above alert thresholds counted per
  hour (or day) and equipment, with a watermark; late rows past it are dropped.
* T03 ``append_history`` / ``latest_predictions``: append-only history plus a
  batch "latest per equipment" view (``max_by``, no sort).
* T04 ``cooldown_stream``: the W07 fold with per-equipment state (last emission
  and series start) in ``applyInPandasWithState``; each call sees one
  micro-batch of one equipment, never its whole history.
* T05 ``rolling_stream``: sliding-window averages.
* T06 ``asof_enrich_stream``: ``foreachBatch`` + the batch as-of join against a
  static operational table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil.functions import rules as R
from vigil.operators.ordered import DEFAULT_BUCKET_SECONDS
from vigil.operators.quality import validate_ranges

ALERT_SENSORS = ("temperature", "vibration", "tool_wear")


def scoring_stream(readings: DataFrame, ranges: Mapping[str, tuple[float, float]],
                   model=None, as_of_col: str = "timestamp") -> DataFrame:
    """Validation warnings + heuristic scores (+ model RUL and rules when a model is given)."""
    from vigil.operators.fleet import score_batch
    out = score_batch(validate_ranges(readings, ranges))
    if model is not None:
        from vigil.operators.ml import predict
        pred = predict(model, out, "model_rul")
        r = R.clamp_rul("model_rul")
        p = R.probability_from_rul(r)
        out = pred.withColumns({
            "model_rul_hours": F.round(r, 2),
            "model_failure_probability": F.round(p, 4),
            "model_confidence": R.confidence(r),
            "maintenance_recommendation": R.recommendation(r, p),
            "predicted_failure_date": R.failure_date(r, F.col(as_of_col)),
        })
    return out


def alert_digest_stream(readings: DataFrame, thresholds: Mapping[str, float] = R.ALERT_THRESHOLDS,
                        window: str = "1 hour", watermark: str = "1 hour",
                        ts: str = "timestamp", by: str = "equipment_id") -> DataFrame:
    """Counts of readings above thresholds per (window, equipment, sensor)."""
    from vigil.operators.quality import threshold_exceedances
    return threshold_exceedances(readings.withWatermark(ts, watermark), thresholds, window, ts, by)


def rolling_stream(readings: DataFrame, columns: Sequence[str], length: str = "8 hours",
                   slide: str = "1 hour", watermark: str = "1 hour", ts: str = "timestamp",
                   by: str = "equipment_id") -> DataFrame:
    """Statistics of sliding windows on a stream; rows behind the watermark are dropped."""
    return sliding_windows(readings.withWatermark(ts, watermark), columns, length, slide, ts, by)


def sliding_windows(readings: DataFrame, columns: Sequence[str], length: str = "8 hours", slide: str = "1 hour",
                    ts: str = "timestamp", by: str = "equipment_id") -> DataFrame:
    """Mean, least and largest value of each column and the row count, per sliding window and equipment."""
    stats = [f(c).alias(f"{c}_{name}") for c in columns for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return readings.groupBy(F.window(ts, length, slide).alias("window"), by).agg(*stats, F.count(F.lit(1)).alias("n"))


def append_history(predictions: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                   ts: str = "timestamp"):
    """Append scored rows to a date-partitioned history table."""
    out = predictions.withColumn("date", F.to_date(ts))
    w = (out.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).partitionBy("date").outputMode("append"))
    return w.trigger(**(trigger or {"availableNow": True})).start()


def latest_predictions(history: DataFrame, by: str = "equipment_id", ts: str = "timestamp",
                       columns: Sequence[str] | None = None) -> DataFrame:
    """The latest row per equipment (one aggregate, no sort, skew-safe).

    All columns come from one row: of rows with the latest time, the one that is greatest in the columns' order.
    """
    cols = list(columns) if columns is not None else [c for c in history.columns if c not in (by,)]
    row = F.max(F.struct(F.col(ts).alias("_at"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(cols)])).alias("_row")
    return history.groupBy(by).agg(row).select(by, *[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(cols)])


COOLDOWN_OUT = "equipment_id string, timestamp timestamp, event_id long, maintenance_type string"
COOLDOWN_STATE = "start timestamp, last_emit timestamp"


def _cooldown_fn(threshold: float, gap_seconds: float, trigger_col: str, flag_col: str):
    gap = pd.Timedelta(seconds=gap_seconds)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, held = None, []
        for p in pdfs:  # only triggered rows are held
            if len(p):
                first = p["timestamp"].min() if first is None else min(first, p["timestamp"].min())
                held.append(p[p[trigger_col].gt(threshold)])
        if first is None:
            return
        if state.exists:
            start, last = state.get
            start = pd.Timestamp(start)
            last = pd.Timestamp(last) if last is not None else None
        else:
            start, last = first, None
        pdf = pd.concat(held).sort_values(["timestamp", "event_id"], ignore_index=True)
        times, ref, emitted = pdf["timestamp"], last if last is not None else start, []
        # one step per emission: the first triggered row later than the last emission plus the gap
        at = int(times.searchsorted(ref + gap, side="right"))
        while at < len(times):
            emitted.append(at)
            last = times.iloc[at]
            at = int(times.searchsorted(last + gap, side="right"))
        state.update((start.to_pydatetime(), last.to_pydatetime() if last is not None else None))
        if emitted:
            rows = pdf.iloc[emitted]
            kind = rows[flag_col].fillna(False).astype(bool).map({True: "corrective", False: "preventive"})
            yield pd.DataFrame({"equipment_id": key[0], "timestamp": rows["timestamp"], "event_id": rows["event_id"].astype("int64"), "maintenance_type": kind})

    return fn


def cooldown_stream(readings: DataFrame, threshold: float = 0.8, gap_seconds: int = 30 * 24 * 3600,
                    trigger_col: str = "degradation_level", flag_col: str = "failure_imminent",
                    watermark: str = "1 day") -> DataFrame:
    """W07 on a stream; per-equipment state = (series start, last emission).

    Rows of one equipment must arrive in time order across micro-batches
    (within a batch they are sorted).  Rows behind the watermark are dropped: Spark filters them
    for event-time timeouts, which is why that mode is named here though no timeout is ever set.
    """
    src = readings.select("equipment_id", "timestamp", "event_id", trigger_col, flag_col) \
        .withWatermark("timestamp", watermark)
    return src.groupBy("equipment_id").applyInPandasWithState(
        _cooldown_fn(threshold, gap_seconds, trigger_col, flag_col), COOLDOWN_OUT, COOLDOWN_STATE,
        "append", GroupStateTimeout.EventTimeTimeout)


def asof_enrich_stream(readings: DataFrame, operational: DataFrame, sink_path: str, checkpoint: str,
                       on: str = "timestamp", by: str = "equipment_id",
                       left_tiebreak: Sequence[str] = (), right_tiebreak: Sequence[str] = (),
                       trigger: dict | None = None, bucket_seconds: int = DEFAULT_BUCKET_SECONDS):
    """Each micro-batch joined as-of against the static operational table.

    A batch is written to the sink's ``epoch=N`` partition, overwriting it: a replayed batch replaces
    its own rows.  Only the operational rows of the batch's equipment enter the join.
    """
    from vigil.operators.asof import asof_join

    def per_batch(batch: DataFrame, epoch: int) -> None:
        here = batch.select(F.col(by).alias("_by")).distinct()
        static = operational.join(here, operational[by].eqNullSafe(F.col("_by")), "left_semi")
        enriched = asof_join(batch, static, on=on, by=[by], left_tiebreak=list(left_tiebreak),
                             right_tiebreak=list(right_tiebreak), bucket_seconds=bucket_seconds)
        enriched.write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch}")

    w = readings.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
