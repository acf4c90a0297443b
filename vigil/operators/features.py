"""Per-equipment statistical features and labels.

All aggregates are ``groupBy().agg()`` with partial (map-side) aggregation, so a
hot equipment never lands whole in one task.  Positional features (trend, the
degradation curve) get their row positions from the skew-safe
``ordered.positions`` instead of a per-equipment window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.ordered import DEFAULT_BUCKET_SECONDS, packed_order, positions, time_bucket

# fixed values (must equal the reference's)
TARGET_COLUMNS = ("degradation_level", "failure_imminent", "rul")
STAT_SUFFIXES = ("mean", "std", "max", "min")
LABEL_RUL_SCALE = 1000.0
LABEL_PROB_CAP = 0.95
LABEL_DEFAULT_RUL = 500.0
SIMPLE_RUL_BASE = 1000.0
SIMPLE_RUL_VIB_RATE = 100.0
SIMPLE_RUL_FLOOR = 100.0
HEURISTIC_RUL_BASE = 1000.0
HEURISTIC_VIB_RATE = 10.0
HEURISTIC_TEMP_PIVOT = 300.0
HEURISTIC_TEMP_RATE = 2.0
HEURISTIC_WEAR_RATE = 0.5
HEURISTIC_RUL_FLOOR = 50.0
LINEAR_FULL_AT = 800.0


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order (booleans are not numeric)."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def feature_columns(df: DataFrame, by: str | None = "equipment_id",
                    targets: Sequence[str] = TARGET_COLUMNS) -> list[str]:
    """P01 + P02: numeric, non-target, non-key columns."""
    return numeric_columns(df, exclude=[*targets, *( [by] if by else [])])


def _stat_exprs(cols: Sequence[str]) -> list[Column]:
    out = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        empty = F.count(x) == 0
        out += [
            F.when(empty, F.lit(0.0)).otherwise(F.avg(x)).alias(f"{c}_mean"),
            F.when(empty, F.lit(0.0)).otherwise(F.stddev_samp(x)).alias(f"{c}_std"),
            F.when(empty, F.lit(0.0)).otherwise(F.max(x)).alias(f"{c}_max"),
            F.when(empty, F.lit(0.0)).otherwise(F.min(x)).alias(f"{c}_min"),
        ]
    return out


def equipment_features(df: DataFrame, by: str | None = "equipment_id",
                       columns: Sequence[str] | None = None) -> DataFrame:
    """A01 (A02 when ``by`` is None): mean, sample std, max, min per column.

    All-NULL column in a group → 0.0 for all four; one value → std NULL.
    """
    cols = list(columns) if columns is not None else feature_columns(df, by)
    if by:
        return df.groupBy(by).agg(*_stat_exprs(cols))
    return df.agg(*_stat_exprs(cols))


def equipment_labels(df: DataFrame, by: str = "equipment_id",
                     order: Sequence[str] = ("timestamp",),
                     degradation: str = "degradation_level") -> DataFrame:
    """RUL from the degradation of the last row per equipment.

    rul = max(0, (1 - d) * 1000), NULL last degradation → 0 (as Python's
    ``max(0, nan)``); failure_probability = min(rul / 1000, .95).  Without a
    degradation column every equipment gets rul 500.
    """
    if degradation not in df.columns:
        rul = F.lit(LABEL_DEFAULT_RUL)
        base = df.select(by).distinct()
        return base.select(by, rul.alias("rul"),
                           F.least(rul / LABEL_RUL_SCALE, F.lit(LABEL_PROB_CAP)).alias("failure_probability"))
    last = F.max_by(F.col(degradation).cast("double"), _order_key(df, order))
    g = df.groupBy(by).agg(last.alias("_d"))
    rul = F.greatest(F.lit(0.0), (1.0 - F.col("_d")) * LABEL_RUL_SCALE)
    return g.select(by, rul.alias("rul"),
                    F.least(rul / LABEL_RUL_SCALE, F.lit(LABEL_PROB_CAP)).alias("failure_probability"))


def heuristic_labels(df: DataFrame, by: str = "equipment_id") -> DataFrame:
    """One table-wide RUL for every equipment when no degradation exists.

    1000 - 10*mean(vibration) - 2*max(0, mean(temperature)-300) - 0.5*mean(tool_wear),
    floor 50; each term only if the column exists.  A NULL mean propagates to a
    NULL result (Python's ``max(nan, 50)`` is nan).
    """
    names = set(df.columns)
    aggs = [F.lit(1).alias("_one")]
    for c in ("vibration", "temperature", "tool_wear"):
        if c in names:
            aggs.append(F.avg(F.col(c).cast("double")).alias(f"_m_{c}"))
    # one row of table-wide means: a bounded driver round-trip, used as literals
    row = df.agg(*aggs).first()
    rul = HEURISTIC_RUL_BASE
    missing = False
    if "vibration" in names:
        m = row["_m_vibration"]
        missing |= m is None
        rul = rul - (m or 0.0) * HEURISTIC_VIB_RATE
    if "temperature" in names:
        t = row["_m_temperature"]
        missing |= t is None
        if t is not None and t > HEURISTIC_TEMP_PIVOT:
            rul = rul - (t - HEURISTIC_TEMP_PIVOT) * HEURISTIC_TEMP_RATE
    if "tool_wear" in names:
        w = row["_m_tool_wear"]
        missing |= w is None
        rul = rul - (w or 0.0) * HEURISTIC_WEAR_RATE
    value = None if missing else max(rul, HEURISTIC_RUL_FLOOR)
    rul_c = F.lit(value).cast("double")
    return df.select(by).distinct().select(
        by, rul_c.alias("rul"),
        F.least(rul_c / LABEL_RUL_SCALE, F.lit(LABEL_PROB_CAP)).alias("failure_probability"))


def with_positions(df: DataFrame, by: str = "equipment_id", ts: str = "timestamp",
                   tiebreak: Sequence[str] = (), out: str = "position",
                   bucket_seconds: int = DEFAULT_BUCKET_SECONDS, count: str | None = None) -> DataFrame:
    """0-based row position inside each equipment, ordered by (ts, tiebreak);
    ``count`` also adds the equipment's row count."""
    order = [F.col(ts), *[F.col(t) for t in tiebreak]]
    return positions(df, by, order, time_bucket(F.col(ts), bucket_seconds), out=out, count=count)


def trend_expr(y: str, x: str = "position") -> Column:
    """Least-squares slope of y on x; NULL for n < 2 or any missing y (numpy gives nan)."""
    yc = F.col(y).cast("double")
    return F.when((F.count(yc) < F.count(F.lit(1))) | (F.count(F.lit(1)) < 2), F.lit(None)
                  ).otherwise(F.regr_slope(yc, F.col(x).cast("double")))


def simple_features(df: DataFrame, by: str = "equipment_id", ts: str = "timestamp",
                    tiebreak: Sequence[str] = (),
                    bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """The simple pipeline's feature row with temperature trend and RUL."""
    pos = with_positions(df.select(by, ts, *tiebreak, "vibration", "temperature", "pressure", "current"),
                         by, ts, tiebreak, "_x", bucket_seconds)
    vib_mean = F.avg(F.col("vibration").cast("double"))
    g = pos.groupBy(by).agg(
        vib_mean.alias("vibration_mean"),
        F.stddev_samp(F.col("vibration").cast("double")).alias("vibration_std"),
        F.avg(F.col("temperature").cast("double")).alias("temperature_mean"),
        trend_expr("temperature", "_x").alias("temperature_trend"),
        F.avg(F.col("pressure").cast("double")).alias("pressure_mean"),
        F.avg(F.col("current").cast("double")).alias("current_mean"),
    )
    rul = F.greatest(SIMPLE_RUL_BASE - F.col("vibration_mean") * SIMPLE_RUL_VIB_RATE,
                     F.lit(SIMPLE_RUL_FLOOR))
    return g.withColumn("rul", F.when(F.col("vibration_mean").isNull(), F.lit(None)).otherwise(rul))


def degradation_curve(df: DataFrame, by: str = "equipment_id", ts: str = "timestamp",
                      tiebreak: Sequence[str] = (), horizon: float = 0.8,
                      failing_above: float = 0.85,
                      bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Progress p = i/n per equipment; d = min((p/horizon)^2, 1); failing when d > .85."""
    j = with_positions(df, by, ts, tiebreak, "_i", bucket_seconds, count="_n")
    p = F.col("_i") / F.col("_n")
    d = F.least(F.pow(p / horizon, 2.0), F.lit(1.0))
    return j.withColumn("progress", p).withColumn("degradation_curve", d) \
        .withColumn("failing", d > failing_above).drop("_i", "_n")


def degradation_linear(df: DataFrame, by: str = "equipment_id", ts: str = "timestamp",
                       tiebreak: Sequence[str] = (), full_at: float = LINEAR_FULL_AT,
                       bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """W05, linear twin: d = min(i / full_at, 1) by row position i per equipment."""
    j = with_positions(df, by, ts, tiebreak, "_i", bucket_seconds)
    return j.withColumn("degradation_linear", F.least(F.col("_i") / F.lit(full_at), F.lit(1.0))).drop("_i")


def group_max_over(df: DataFrame, by: str, col: str, out: str) -> DataFrame:
    """Attach max(col) of the row's group (an aggregate joined back over salts, not a hot window)."""
    from vigil.operators.ordered import join_salted
    m = df.groupBy(by).agg(F.max(col).alias(out))
    return join_salted(df, m, [by], "left")


def _order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """Hash-aggregatable ordering key: packed (timestamp, integral tiebreak) when the
    order has that shape, else a struct (sort-based aggregate)."""
    types = [df.schema[o].dataType for o in order]
    if (len(order) in (1, 2) and isinstance(types[0], T.TimestampType)
            and (len(order) == 1 or isinstance(types[1], T.IntegralType))):
        return packed_order(F.col(order[0]), F.col(order[1]) if len(order) == 2 else None)
    return F.struct(*[F.col(o) for o in order])


def last_row_per_group(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Values of the last row per group via ``max_by`` (aggregate, no sort)."""
    ordc = _order_key(df, order)
    return df.groupBy(by).agg(*[F.max_by(F.col(c), ordc).alias(c) for c in cols])
