"""Raw dataset normalisers (P03–P07): one ``select`` each, no row loops.

They turn the AI4I CSV and the CMAPSS text tables into the canonical sensor /
maintenance tables.  Global or per-unit maxima are aggregates joined back
(not per-row recomputation, not a per-unit window on a hot unit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.ordered import join_salted

# fixed values (must equal the reference's)
AI4I_BASE = "2020-01-01 00:00:00"
CMAPSS_BASE = "2023-01-01 00:00:00"
AI4I_WEAR_FULL = 200.0
CMAPSS_FAILING_SHARE = 0.9
FAILURE_TYPES = (
    ("TWF", "Tool Wear Failure"),
    ("HDF", "Heat Dissipation Failure"),
    ("PWF", "Power Failure"),
    ("OSF", "Overstrain Failure"),
    ("RNF", "Random Failure"),
)
NO_FAILURE = "No Failure"
CMAPSS_SENSOR_MAP = (("sensor_1", "vibration"), ("sensor_2", "temperature"), ("sensor_3", "pressure"),
                     ("sensor_4", "current"), ("sensor_5", "rpm"))
AI4I_MAINTENANCE = {"maintenance_type": "corrective", "parts_replaced": "bearings, tools",
                    "technician": "Tech_01"}
CMAPSS_MAINTENANCE = {"maintenance_type": "corrective", "description": "Engine failure - replacement required",
                      "parts_replaced": "turbine blades, bearings", "technician": "NASA_Tech_01",
                      "downtime_hours": 48.0}
AI4I_V1_MAINTENANCE = {"maintenance_type": "corrective", "description": "Machine failure detected",
                       "parts_replaced": "tool, bearings", "technician": "Tech_01", "downtime_hours": 8.0}

# raw AI4I column names
UDI, PRODUCT, AIR_K, PROC_K, RPM, TORQUE, WEAR, FAILED = (
    "UDI", "Product ID", "Air temperature [K]", "Process temperature [K]", "Rotational speed [rpm]",
    "Torque [Nm]", "Tool wear [min]", "Machine failure")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def hours_after(base: str, hours: Column) -> Column:
    """Timestamp ``base`` + ``hours`` (integral) hours."""
    return F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(base)))
                              + hours.cast("long") * F.lit(3600 * 1_000_000))


def failure_type(df_cols=None) -> Column:
    """First failure flag set wins, in the fixed order; independent of the failure flag."""
    expr = None
    for flag, text in FAILURE_TYPES:
        cond = _q(flag) == 1
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr.otherwise(F.lit(NO_FAILURE))


def zero_pad(n: Column, width: int) -> Column:
    """``%0{width}d`` of an integer column with codegen-friendly string functions
    (the sign counts toward the width; wider numbers are kept whole)."""
    a = F.abs(n.cast("long")).cast("string")
    pos = F.when(F.length(a) < width, F.lpad(a, width, "0")).otherwise(a)
    neg = F.concat(F.lit("-"), F.when(F.length(a) < width - 1, F.lpad(a, width - 1, "0")).otherwise(a))
    return F.when(n < 0, neg).otherwise(pos)


def engine_id(unit: Column) -> Column:
    """``Engine_%03d``."""
    return F.concat(F.lit("Engine_"), zero_pad(unit, 3))


def machine_id(product: Column) -> Column:
    return F.concat(F.lit("Machine_"), F.replace(product, F.lit("M"), F.lit("")))


def normalize_ai4i(raw: DataFrame) -> DataFrame:
    """AI4I raw rows → canonical sensor rows (v2 rules)."""
    return raw.select(
        hours_after(AI4I_BASE, _q(UDI)).alias("timestamp"),
        machine_id(_q(PRODUCT)).alias("equipment_id"),
        (_q(AIR_K).cast("double") / 100.0).alias("vibration"),
        _q(PROC_K).cast("double").alias("temperature"),
        (_q(RPM).cast("double") / 10.0).alias("pressure"),
        _q(TORQUE).cast("double").alias("current"),
        _q(RPM).cast("double").alias("rpm"),
        _q(WEAR).cast("long").alias("tool_wear"),
        F.least(_q(WEAR).cast("double") / AI4I_WEAR_FULL, F.lit(1.0)).alias("degradation_level"),
        (_q(FAILED) == 1).alias("failure_imminent"),
        failure_type().alias("failure_type"),
    )


def normalize_ai4i_v1(raw: DataFrame) -> DataFrame:
    """The older rules — degradation = wear / global max wear; the text timestamp
    ``2020-01-{UDI//24+1:02d} {UDI%24:02d}:00:00`` parses to NULL past day 31."""
    # the global max is one value: fetched once and used as a literal
    mx = raw.agg(F.max(_q(WEAR)).alias("_mx")).first()["_mx"]
    udi = _q(UDI).cast("long")
    text = F.format_string("2020-01-%02d %02d:00:00", (F.floor(udi / 24) + 1).cast("int"),
                           F.pmod(udi, F.lit(24)).cast("int"))
    return raw.select(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        machine_id(_q(PRODUCT)).alias("equipment_id"),
        (_q(AIR_K).cast("double") / 100.0).alias("vibration"),
        _q(PROC_K).cast("double").alias("temperature"),
        (_q(RPM).cast("double") / 10.0).alias("pressure"),
        _q(TORQUE).cast("double").alias("current"),
        _q(RPM).cast("double").alias("rpm"),
        F.try_divide(_q(WEAR).cast("double"), F.lit(mx).cast("double")).alias("degradation_level"),
        (_q(FAILED) == 1).alias("failure_imminent"),
    )


def ai4i_maintenance(raw: DataFrame, downtime_hours: Column | float = 8.0) -> DataFrame:
    """One corrective maintenance row per failed machine reading.

    ``downtime_hours`` is random in the reference; here it is a parameter.
    """
    dt = downtime_hours if isinstance(downtime_hours, Column) else F.lit(float(downtime_hours))
    return raw.filter(_q(FAILED) == 1).select(
        hours_after(AI4I_BASE, _q(UDI)).alias("timestamp"),
        machine_id(_q(PRODUCT)).alias("equipment_id"),
        F.lit(AI4I_MAINTENANCE["maintenance_type"]).alias("maintenance_type"),
        F.concat(F.lit("Failure: "), failure_type()).alias("description"),
        F.lit(AI4I_MAINTENANCE["parts_replaced"]).alias("parts_replaced"),
        F.lit(AI4I_MAINTENANCE["technician"]).alias("technician"),
        dt.alias("downtime_hours"),
    )


def normalize_cmapss(raw: DataFrame) -> DataFrame:
    """P05 + W04: CMAPSS rows → canonical sensor rows.

    id ``Engine_%03d``; time = base + cycle hours (the reference's text form is
    invalid past hour 23); sensors 1–5 → the five canonical names; degradation
    = cycle / max cycle of the unit; failing when cycle > 0.9 * max.
    """
    mx = raw.groupBy("unit").agg(F.max("cycle").alias("_max_cycle"))
    j = join_salted(raw, mx, ["unit"], "left")
    cols = [engine_id(F.col("unit")).alias("equipment_id"),
            hours_after(CMAPSS_BASE, F.col("cycle")).alias("timestamp")]
    names = set(raw.columns)
    for src, dst in CMAPSS_SENSOR_MAP:
        cols.append((F.col(src).cast("double") if src in names else F.lit(0.0)).alias(dst))
    cols += [(F.col("cycle") / F.col("_max_cycle")).alias("degradation_level"),
             (F.col("cycle") > F.col("_max_cycle") * CMAPSS_FAILING_SHARE).alias("failure_imminent")]
    return j.select(*cols)


def cmapss_maintenance(raw: DataFrame) -> DataFrame:
    """One end-of-life maintenance row per unit (its last cycle)."""
    last = raw.groupBy("unit").agg(F.max("cycle").alias("_c"))
    return last.select(
        hours_after(CMAPSS_BASE, F.col("_c")).alias("timestamp"),
        engine_id(F.col("unit")).alias("equipment_id"),
        *[F.lit(v).alias(k) for k, v in CMAPSS_MAINTENANCE.items()])


def failure_maintenance(sensor: DataFrame, flag: str = "failure_imminent") -> DataFrame:
    """P07 (v1 form): maintenance rows for sensor rows whose failure flag is set."""
    return sensor.filter(F.col(flag)).select(
        "timestamp", "equipment_id", *[F.lit(v).alias(k) for k, v in AI4I_V1_MAINTENANCE.items()])
