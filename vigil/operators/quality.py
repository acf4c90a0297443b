"""Expected ranges and data-quality checks.

Ranges have one row per sensor, a size bounded by the schema, so they are the
one kind of table we broadcast (or inline as literals) without a runtime check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values (must equal the reference's): canonical sensor → accepted column names
SENSOR_ALIASES = {
    "vibration": ["vibration", "vibration_x", "vibration_y", "vibration_z", "vib_x", "vib_y", "vib_z"],
    "temperature": ["temperature", "temp", "air_temperature", "process_temperature"],
    "pressure": ["pressure", "air_pressure", "process_pressure"],
    "current": ["current", "motor_current", "torque"],
    "rpm": ["rpm", "rotational_speed", "rotation_speed"],
    "tool_wear": ["tool_wear", "tool_wear_min", "tool_wear_max"],
}
WARNING_FORMAT = "%s=%s outside expected range [%.2f, %.2f]"
RANGE_SIGMAS = 3.0


def resolve_sensor_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]] = SENSOR_ALIASES
                           ) -> dict[str, str]:
    """P10: canonical sensor → first *numeric* column present among its aliases (missing → skipped)."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    out = {}
    for api, names in aliases.items():
        for n in names:
            if n in numeric:
                out[api] = n
                break
    return out


def expected_ranges(df: DataFrame, sensors: Mapping[str, str] | Sequence[str] | None = None,
                    n_sigma: float = RANGE_SIGMAS) -> DataFrame:
    """Long table ``(sensor, min, max, mean, std)``; min = max(0, mean - kσ), max = mean + kσ.

    σ is the sample standard deviation.  One aggregate pass for all sensors.
    """
    if sensors is None:
        sensors = resolve_sensor_aliases(df)
    elif not isinstance(sensors, Mapping):
        sensors = {s: s for s in sensors}
    aggs = []
    rows = []
    for i, (api, col) in enumerate(sensors.items()):
        x = F.col(f"`{col}`").cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
        rows.append(F.struct(F.lit(api).alias("sensor"), F.col(f"m{i}").alias("mean"),
                             F.col(f"s{i}").alias("std")))
    moments = df.agg(*aggs).select(F.inline(F.array(*rows)))
    return moments.select(
        "sensor",
        F.greatest(F.lit(0.0), F.col("mean") - n_sigma * F.col("std")).alias("min"),
        (F.col("mean") + n_sigma * F.col("std")).alias("max"),
        "mean", "std")


def unpivot_sensors(df: DataFrame, ids: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """Long form ``(ids..., sensor, value)`` of the sensor columns."""
    return df.select(*ids, *[F.col(s).cast("double").alias(s) for s in sensors]) \
        .unpivot(list(ids), list(sensors), "sensor", "value")


def warning_text(sensor: Column, value: Column, lo: Column, hi: Column) -> Column:
    """F03 text: ``{sensor}={value} outside expected range [{min:.2f}, {max:.2f}]``
    (the value printed as Python prints a float)."""
    from vigil.functions.rules import py_float_text
    return F.format_string(WARNING_FORMAT, sensor, py_float_text(value), lo, hi)


def range_violations(df: DataFrame, ranges: DataFrame, ids: Sequence[str],
                     sensors: Sequence[str] | None = None) -> DataFrame:
    """One row per (reading, sensor) outside its range, with the warning text.

    Equi-join on sensor name against the ranges table (one row per sensor; AQE broadcasts it
    once its size is measured), theta-condition value < min or value > max.  NULL values never warn.
    """
    if sensors is None:
        sensors = [r["sensor"] for r in ranges.select("sensor").collect()]
    long = unpivot_sensors(df, ids, sensors)
    j = long.join(ranges.select("sensor", "min", "max"), "sensor")
    bad = j.filter((F.col("value") < F.col("min")) | (F.col("value") > F.col("max")))
    return bad.withColumn("warning", warning_text(F.col("sensor"), F.col("value"),
                                                  F.col("min"), F.col("max")))


def validate_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]] | DataFrame,
                    out: str = "data_quality_warnings") -> DataFrame:
    """add an array of warnings per row (NULL when clean), sensors in range order.

    Works on streams too: the ranges become literals (bounded: one per sensor).
    """
    from vigil.functions.rules import py_float_text
    if isinstance(ranges, DataFrame):
        ranges = {r["sensor"]: (r["min"], r["max"]) for r in ranges.collect()}
    items = []
    for sensor, (lo, hi) in ranges.items():
        if sensor not in df.columns or lo is None or hi is None:
            continue
        v = F.col(sensor).cast("double")
        # The text is made below, once, and only for the values out of range.
        items.append(F.when((v < lo) | (v > hi), F.struct(F.lit(f"{sensor}=").alias("head"), v.alias("value"),
                                                          F.lit(f" outside expected range [{lo:.2f}, {hi:.2f}]").alias("tail"))))
    if not items:
        return df.withColumn(out, F.lit(None).cast("array<string>"))
    bad = F.filter(F.array(*items), lambda x: x.isNotNull())
    text = F.transform(bad, lambda x: F.concat(x["head"], py_float_text(x["value"]), x["tail"]))
    # One array holds the warnings of a row, so no expression names them twice.
    return df.withColumn(out, F.get(F.filter(F.array(text), lambda w: F.size(w) > 0), F.lit(0)))


def flatten_warnings(df: DataFrame, id_col: str = "equipment_id",
                     col: str = "data_quality_warnings") -> DataFrame:
    """``"{id}: {warning}"`` rows, one per warning."""
    return df.select(id_col, F.explode(col).alias("warning")) \
        .select(F.concat_ws(": ", F.col(id_col).cast("string"), F.col("warning")).alias("flat_warning"))


@dataclass
class SchemaDrift:
    """Difference between an expected column list and a DataFrame's."""
    missing: list[str] = field(default_factory=list)
    extra: list[str] = field(default_factory=list)
    reordered: bool = False

    @property
    def ok(self) -> bool:
        return not self.missing and not self.extra and not self.reordered


def schema_drift(expected: Sequence[str], df: DataFrame) -> SchemaDrift:
    """Missing / extra / reordered names (driver-side, on the schema only)."""
    have = list(df.columns)
    exp = list(expected)
    missing = [c for c in exp if c not in have]
    extra = [c for c in have if c not in exp]
    common_have = [c for c in have if c in exp]
    common_exp = [c for c in exp if c in have]
    return SchemaDrift(missing, extra, common_have != common_exp)


def threshold_table(spark, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """The per-sensor critical-threshold dimension (one row per sensor)."""
    from vigil.functions.rules import CRITICAL_THRESHOLDS
    t = thresholds or CRITICAL_THRESHOLDS
    return spark.createDataFrame([(k, float(v)) for k, v in t.items()], "sensor string, threshold double")


def critical_readings(df: DataFrame, ids: Sequence[str], thresholds: Mapping[str, float] | None = None
                      ) -> DataFrame:
    """R20 + J05: one row per (reading, sensor) above its critical threshold.

    The threshold table has one row per sensor (bounded by the schema), so it
    is broadcast; the readings are unpivoted to long form and equi-joined on
    the sensor name.
    """
    from vigil.functions.rules import CRITICAL_THRESHOLDS
    t = thresholds or CRITICAL_THRESHOLDS
    dim = threshold_table(df.sparkSession, t)
    sensors = [s for s in t if s in df.columns]
    long = unpivot_sensors(df, ids, sensors)
    return long.join(F.broadcast(dim), "sensor").filter(F.col("value") > F.col("threshold"))


def exceeding_readings(df: DataFrame, thresholds: Mapping[str, float], ids: Sequence[str]) -> DataFrame:
    """T02, immediate alerts: one row (ids..., sensor, value) per reading above its sensor's alert threshold."""
    sensors = [s for s in thresholds if s in df.columns]
    thr = F.create_map(*[x for s in sensors for x in (F.lit(s), F.lit(float(thresholds[s])))])
    return unpivot_sensors(df, ids, sensors).filter(F.col("value") > F.element_at(thr, F.col("sensor")))


def threshold_exceedances(df: DataFrame, thresholds: Mapping[str, float], window: str = "1 hour",
                          ts: str = "timestamp", by: str = "equipment_id") -> DataFrame:
    """Readings above per-sensor alert thresholds counted per (time window, equipment, sensor).

    Works on batch and streaming frames (a stream adds its watermark before calling).
    """
    sensors = [s for s in thresholds if s in df.columns]
    hot = exceeding_readings(df, {s: thresholds[s] for s in sensors}, [by, ts])
    return hot.groupBy(F.window(ts, window).alias("window"), by, "sensor").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"))
