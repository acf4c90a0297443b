"""Driver test tables re-read as equipment-health tables.

The test tables are generic (TPC-H-like plus an ``events`` table).  These views
give them the reference's data model so every registered query runs over the
whole tables:

* ``events`` → sensor readings: equipment = ``user_id``, time = ``ts``,
  tiebreak = ``event_id``, six pseudo-sensors from ``value`` and ``props.k``,
  degradation = position / count per user, failure flag = error events;
* ``lineitem`` → multi-sensor table: equipment = ``l_suppkey``, time =
  ``l_shipdate``, sensors = quantity, price, discount, tax.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.features import with_positions
from vigil.sources.tables import read_table

EVENT_SENSORS = ("vibration", "temperature", "pressure", "current", "rpm", "tool_wear")
LINEITEM_SENSORS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def k_of(props) -> F.Column:
    """Integer ``k`` of the JSON ``props`` column."""
    return F.get_json_object(props, "$.k").cast("int")


def events_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the parsed ``k``."""
    ev = read_table(spark, sf_dir, "events")
    return ev.withColumn("k", k_of(F.col("props"))).drop("props")


def sensor_columns(ev: DataFrame, value: str = "value") -> dict[str, F.Column]:
    """Pseudo-sensors of FIXTURES §3 from ``value`` and ``k``."""
    v, k = F.col(value), F.col("k")
    return {
        "vibration": F.lit(2.95) + k / 1000.0,
        "temperature": F.lit(305.0) + v / 50.0,
        "pressure": (F.lit(100) + k).cast("double"),
        "current": F.least(F.lit(70.0), F.lit(10.0) + v / 5.0),
        "rpm": (F.lit(1000) + F.lit(10) * k).cast("double"),
        "tool_wear": F.pmod(F.col("user_id") * 7 + F.col("event_id"), F.lit(300)).cast("double"),
    }


def event_readings(spark: SparkSession, sf_dir: str, with_degradation: bool = True,
                   gaps: bool = False) -> DataFrame:
    """Sensor table from events.

    Columns: event_id, timestamp, equipment_id (string), event_type, value, k,
    the six sensors, failure_imminent and (optionally) degradation_level =
    (position + 1) / count per equipment.  ``gaps=True`` sets ``value`` (and the
    sensors derived from it) to NULL on error events.
    """
    ev = events_base(spark, sf_dir)
    ev = ev.select(
        "event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"),
        "user_id", "event_type",
        (F.when(F.col("event_type") != "error", F.col("value")) if gaps else F.col("value")).alias("value"),
        "k")
    ev = ev.withColumns(sensor_columns(ev)).withColumn("failure_imminent", F.col("event_type") == "error")
    if with_degradation:
        ev = with_positions(ev, "equipment_id", "timestamp", ["event_id"], out="_pos", count="_n")
        ev = ev.withColumn("degradation_level", (F.col("_pos") + 1) / F.col("_n")).drop("_pos", "_n")
    return ev.drop("user_id")


def lineitem_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-sensor table from lineitem (equipment = supplier)."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", *LINEITEM_SENSORS])
    return li.select(F.col("l_suppkey").cast("string").alias("equipment_id"),
                     F.col("l_shipdate").alias("timestamp"), "l_orderkey", "l_linenumber",
                     *LINEITEM_SENSORS)
