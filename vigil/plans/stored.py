"""Registered queries that go through files or streams: tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigil.operators import quality
from vigil.plans.readings import EVENT_SENSORS, LINEITEM_SENSORS, event_readings, lineitem_readings
from vigil.plans.util import finish
from vigil.session import ensure_checkpoint_dir
from vigil.sources import files
from vigil.sources.tables import read_table
from vigil.streaming import jobs as streaming

_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text_time(c: str = "timestamp"):
    return F.date_format(c, _TIME).alias(c)


def q_csv_readings(spark, sf_dir):
    """S01 + S06 + S08: readings written as CSV with shuffled and further columns, read back by header name."""
    path = _folder(spark, "csv")
    rd = event_readings(spark, sf_dir)
    out = rd.select("event_id", "failure_imminent", "degradation_level", "rpm", "current", "pressure", "temperature", "vibration", "equipment_id", _text_time())
    files.write_table(out, path, fmt="csv")
    back = files.read_csv(spark, path, files.SENSOR_SCHEMA)
    return finish(back.select(F.col("event_id").cast("long").alias("event_id"), _text_time(), "equipment_id", "vibration", "temperature", "pressure", "current",
                              "rpm", "degradation_level", "failure_imminent"))


def q_bad_times(spark, sf_dir):
    """S08, coercing: text times of which every thirteenth is no time."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts"])
    text = F.when(F.col("event_id") % 13 == 0, F.lit("soon")).otherwise(F.date_format("ts", _TIME))
    out = files.parse_timestamps(ev.select("event_id", text.alias("timestamp")), strict=False)
    return finish(out.select("event_id", _text_time()))


def q_cmapss_text(spark, sf_dir):
    """Line items written as headerless text of 26 fields (some broken), read back by position."""
    path = _folder(spark, "cmapss")
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_linenumber", "l_orderkey", *LINEITEM_SENSORS])
    broken = F.when(F.col("l_orderkey") % 17 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    fields = [F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_orderkey"), F.lit("0.5"), F.lit("-1"), broken, F.col("l_extendedprice"), *[F.lit(str(k)) for k in range(3, 22)]]
    li.select(F.concat_ws("  ", *[f.cast("string") for f in fields]).alias("value")).write.text(path)
    back = files.read_cmapss(spark, path)
    return finish(back.select("unit", "cycle", "op_setting_1", "op_setting_3", "sensor_1", "sensor_2", "sensor_21"))


def q_ai4i_csv(spark, sf_dir):
    """Raw AI4I rows written as CSV in another column order, read back by name."""
    from vigil.plans.more import _ai4i
    path = _folder(spark, "ai4i")
    raw = _ai4i(spark, sf_dir).withColumn("Type", F.lit("L"))
    files.write_table(raw.select(*reversed(raw.columns)), path, fmt="csv")
    back = files.read_ai4i(spark, path)
    return finish(back.select(F.col("UDI").alias("udi"), F.col("Product ID").alias("product"), F.col("Tool wear [min]").alias("wear"),
                              F.col("Air temperature [K]").alias("air"), F.col("Machine failure").alias("failed"), "RNF"))


def q_ranges_json(spark, sf_dir):
    """Expected ranges written as one JSON object and read back."""
    path = _folder(spark, "ranges")
    files.write_ranges_json(quality.expected_ranges(lineitem_readings(spark, sf_dir), LINEITEM_SENSORS), path)
    return finish(files.read_ranges_json(spark, path))


def _stream(spark, df, name: str):
    """``df`` written once, as a stream of its files."""
    path = _folder(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def q_scored_history(spark, sf_dir):
    """T01 + T03: readings scored as a stream, appended to the dated history, and its latest row per equipment."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    ranges = {s: (0.0, 1e9) for s in EVENT_SENSORS}
    scored = streaming.scoring_stream(_stream(spark, rd, "readings"), ranges).select("event_id", "timestamp", "equipment_id", "health_score", "failure_probability")
    path = _folder(spark, "history")
    streaming.append_history(scored, path, _folder(spark, "history-checkpoint")).awaitTermination()
    return finish(streaming.latest_predictions(spark.read.parquet(path).drop("date"), "equipment_id", "timestamp", ["health_score", "failure_probability"]))


def q_cooldown_stream(spark, sf_dir):
    """The cooldown fold with per-equipment state on a stream."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"]).select(
        "event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"),
        F.col("value").alias("degradation_level"), (F.col("event_type") == "error").alias("failure_imminent"))
    path = _folder(spark, "cooldown")
    out = streaming.cooldown_stream(_stream(spark, ev, "readings"), 20.0, 5 * 24 * 3600, watermark="365 days")
    (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", _folder(spark, "cooldown-checkpoint"))
        .trigger(availableNow=True).start().awaitTermination())
    return finish(spark.read.schema(out.schema).parquet(path))


def q_asof_stream(spark, sf_dir):
    """The as-of join per micro-batch, read back from its sink."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    left = ev.filter("event_type <> 'view'").select("event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"), "value")
    right = ev.filter("event_type = 'view'").select(F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"),
                                                    F.col("event_id").alias("view_event_id"), F.col("value").alias("view_value"))
    path = _folder(spark, "asof")
    streaming.asof_enrich_stream(_stream(spark, left, "readings"), right, path, _folder(spark, "asof-checkpoint"),
                                 left_tiebreak=["event_id"], right_tiebreak=["view_event_id"]).awaitTermination()
    out = spark.read.parquet(path)
    return finish(out.select("event_id", "equipment_id", "value", F.col("view_event_id").cast("string").alias("view_event_id"), "view_value"))


def queries() -> dict:
    return {k[2:]: f for k, f in globals().items() if k.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    from vigil.plans.more import oracle_sql as more
    from vigil.plans.oracle import _ev, _ranges_union
    rd, text = "WITH " + _ev(), "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
    return {
        "csv_readings": f"""{rd}
SELECT event_id, {text.format('"timestamp"')} AS "timestamp", equipment_id, round(vibration, 6) AS vibration, round(temperature, 6) AS temperature, round(pressure, 6) AS pressure,
  round(current, 6) AS current, round(rpm, 6) AS rpm, round(degradation_level, 6) AS degradation_level, failure_imminent FROM rd""",
        "bad_times": f"""SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN {text.format('ts')} END AS "timestamp" FROM events""",
        "cmapss_text": """
SELECT l_suppkey AS unit, CAST(l_linenumber AS BIGINT) AS cycle, CAST(l_orderkey AS DOUBLE) AS op_setting_1, CAST(-1.0 AS DOUBLE) AS op_setting_3,
  CASE WHEN l_orderkey % 17 <> 0 THEN round(CAST(l_quantity AS DOUBLE), 6) END AS sensor_1, round(CAST(l_extendedprice AS DOUBLE), 6) AS sensor_2, CAST(21.0 AS DOUBLE) AS sensor_21
FROM lineitem""",
        "ai4i_csv": f"""{rd}
SELECT event_id AS udi, 'M' || equipment_id AS product, CAST(tool_wear AS BIGINT) AS wear, round(temperature, 6) AS air,
  CAST(event_type = 'error' AS INTEGER) AS failed, CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS "RNF" FROM rd""",
        "ranges_json": f"""
SELECT sensor, round(mn, 6) AS "min", round(mx, 6) AS "max", round(mean, 6) AS mean, round(std, 6) AS std FROM {_ranges_union('lineitem', LINEITEM_SENSORS, 3.0)} r""",
        "scored_history": more()["latest_predictions"],
        "cooldown_stream": """
WITH RECURSIVE rd AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS e, event_type = 'error' AS failing, value FROM events),
c AS (SELECT * FROM rd WHERE value > 20.0),
st AS (SELECT e, min(ts) + INTERVAL 5 DAY AS probe FROM rd GROUP BY 1),
first_e AS (SELECT arg_min(c.event_id, c.ts) AS event_id FROM st JOIN c ON st.e = c.e AND c.ts > probe GROUP BY st.e),
nx AS (SELECT a.event_id, arg_min(b.event_id, b.ts) AS nxt FROM c a JOIN c b ON a.e = b.e AND b.ts > a.ts + INTERVAL 5 DAY GROUP BY a.event_id),
chain(event_id) AS (SELECT event_id FROM first_e UNION ALL SELECT nx.nxt FROM chain JOIN nx ON nx.event_id = chain.event_id)
SELECT c.e AS equipment_id, c.ts AS "timestamp", c.event_id, CASE WHEN failing THEN 'corrective' ELSE 'preventive' END AS maintenance_type FROM chain JOIN c USING (event_id)""",
        "asof_stream": """
WITH l AS (SELECT event_id, ts, user_id, value FROM events WHERE event_type <> 'view'),
v AS (SELECT event_id AS vid, ts AS vts, user_id, value AS vv FROM events WHERE event_type = 'view')
SELECT l.event_id, CAST(l.user_id AS VARCHAR) AS equipment_id, round(l.value, 6) AS value, CAST(v.vid AS VARCHAR) AS view_event_id, round(v.vv, 6) AS view_value
FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts >= v.vts""",
    }
