"""Registered queries of operators that no other query runs, each next to its DuckDB SQL.

The tables are re-read as in ``readings``; SQL fragments come from ``oracle``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import clean, features, ml, normalize, profile, quality, series, split
from vigil.operators.features import last_row_per_group
from vigil.plans.readings import EVENT_SENSORS, event_readings
from vigil.plans.util import finish
from vigil.sources.files import concat_frames, split_requests
from vigil.sources.tables import read_table
from vigil.streaming.jobs import latest_predictions


def _rd(spark, sf_dir, **kw):
    return event_readings(spark, sf_dir, with_degradation=False, **kw)


# --- readings with warnings ---------------------------------------------------

def q_validated_readings(spark, sf_dir):
    """F03 + A26: every reading with its number of warnings and the joined texts (NULL sensors never warn)."""
    rd = _rd(spark, sf_dir, gaps=True)
    rng = quality.expected_ranges(rd, EVENT_SENSORS, n_sigma=1.0)
    out = quality.validate_ranges(rd, rng)
    n = F.coalesce(F.size("data_quality_warnings"), F.lit(0))
    return finish(out.select("event_id", F.when(n > 0, n).otherwise(0).cast("long").alias("n_warnings"),
                             F.concat_ws("; ", F.array_sort("data_quality_warnings")).alias("warnings")))


def q_warning_totals(spark, sf_dir):
    """Readings, readings with warnings, warnings in all, and rows of the flat list."""
    rd = _rd(spark, sf_dir)
    rng = quality.expected_ranges(rd, EVENT_SENSORS, n_sigma=1.0)
    out = quality.validate_ranges(rd, rng)
    lines = out.select("equipment_id", F.posexplode_outer("data_quality_warnings").alias("at", "warning"))
    flat = F.concat_ws(": ", F.col("equipment_id").cast("string"), F.col("warning"))
    return finish(lines.agg(
        F.count_if(F.col("at").isNull() | (F.col("at") == 0)).alias("readings"), F.count_if(F.col("at") == 0).alias("with_warnings"),
        F.count("at").alias("warnings"), F.count("warning").alias("flat_rows"), F.count_distinct(F.when(F.col("at").isNotNull(), flat)).alias("flat_distinct")))


# --- preparation ----------------------------------------------------------------

def q_feature_columns(spark, sf_dir):
    """P01 + P02: A01 over the columns it picks itself: numeric, neither key nor target (failure_probability, rul)."""
    rd = _rd(spark, sf_dir).select("equipment_id", "vibration", "current", "event_type", "failure_imminent",
                                   F.lit(1.0).alias("degradation_level"), F.lit(2.0).alias("rul"))
    return finish(features.equipment_features(rd, "equipment_id"))


def q_prepare_xy(spark, sf_dir):
    """M01 + J03 + P08 + P09: features with NULLs joined to labels by equipment, zero-filled."""
    rd = _rd(spark, sf_dir, gaps=True)
    feats = rd.groupBy("equipment_id").agg(F.stddev_samp("temperature").alias("temperature_std"), F.min("value").alias("value_min"))
    feats = feats.withColumn("value_min", F.when(F.col("value_min") > 0.5, F.col("value_min")))
    labels = features.equipment_labels(rd.withColumn("degradation_level", F.col("tool_wear") / 300.0), "equipment_id", ["timestamp", "event_id"])
    out, columns = ml.prepare_xy(feats, labels.filter(F.col("rul") > 100.0), "equipment_id", "rul")
    return finish(out.select("equipment_id", *columns, "rul"))


def q_sensor_aliases(spark, sf_dir):
    """P10: ranges of sensors found under their other names (the first numeric alias wins, text does not)."""
    rd = _rd(spark, sf_dir).select(F.col("vibration").cast("string").alias("vibration"), F.col("vibration").alias("vib_x"),
                                   F.col("temperature").alias("process_temperature"), F.col("current").alias("torque"),
                                   F.col("rpm").alias("rotational_speed"))
    found = quality.resolve_sensor_aliases(rd)
    return finish(quality.expected_ranges(rd, found))


def q_basic_vector(spark, sf_dir):
    """The fixed-width vector of readings with NULL sensors."""
    rd = _rd(spark, sf_dir, gaps=True).select("event_id", "vibration", "temperature", "tool_wear")
    return finish(ml.basic_vector(rd, keep=["event_id"], width=15))


# --- datasets -------------------------------------------------------------------

def _ai4i(spark, sf_dir):
    """events as raw AI4I rows: UDI = event id, wear from ids, flags from the event type and k."""
    rd = _rd(spark, sf_dir)
    flag = lambda c: c.cast("int")
    return rd.select(
        F.col("event_id").cast("long").alias("UDI"), F.concat(F.lit("M"), F.col("equipment_id")).alias("Product ID"),
        F.col("temperature").alias("Air temperature [K]"), (F.col("temperature") + 10).alias("Process temperature [K]"),
        F.col("rpm").cast("long").alias("Rotational speed [rpm]"), F.col("current").alias("Torque [Nm]"),
        F.col("tool_wear").cast("long").alias("Tool wear [min]"), flag(F.col("event_type") == "error").alias("Machine failure"),
        flag(F.col("k") % 2 == 0).alias("TWF"), flag(F.col("k") % 3 == 0).alias("HDF"), flag(F.col("k") % 5 == 0).alias("PWF"),
        flag(F.col("k") % 7 == 0).alias("OSF"), flag(F.col("k") % 11 == 0).alias("RNF"))


def q_ai4i_normalize(spark, sf_dir):
    """P03 + P06: raw rows to canonical readings."""
    out = normalize.normalize_ai4i(_ai4i(spark, sf_dir))
    return finish(out.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))


def q_ai4i_normalize_v1(spark, sf_dir):
    """Wear over the largest wear; hours past day 31 have no time."""
    out = normalize.normalize_ai4i_v1(_ai4i(spark, sf_dir))
    return finish(out.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))


def q_ai4i_maintenance(spark, sf_dir):
    """One maintenance row per failed raw row."""
    out = normalize.ai4i_maintenance(_ai4i(spark, sf_dir))
    return finish(out.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))


# --- inspection -----------------------------------------------------------------

def q_outlier_report(spark, sf_dir):
    """Rows before and after the z-score filter at 1.5."""
    rd = _rd(spark, sf_dir).select("event_id", "value", "k")
    after = clean.remove_outliers(rd, ["value", "k"], threshold=1.5)
    report = clean.outlier_report(rd, after)
    return finish(after.agg(F.lit(report.rows_in).cast("long").alias("rows_in"), F.lit(report.rows_out).cast("long").alias("rows_out"), F.lit(report.removed).cast("long").alias("removed")))


def q_distinct_equipment(spark, sf_dir):
    """A22 / U02."""
    return finish(profile.distinct_equipment(_rd(spark, sf_dir)))


def q_invalid_timestamps(spark, sf_dir):
    """Text times of which every thirteenth does not parse."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts"])
    text = F.when(F.col("event_id") % 13 == 0, F.lit("2024-13-45 99:00:00")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return finish(profile.invalid_timestamp_count(ev.select(text.alias("t")), "t", "yyyy-MM-dd HH:mm:ss"))


def q_preview(spark, sf_dir):
    """The first ten readings in time order."""
    return finish(profile.preview(_rd(spark, sf_dir).select("event_id", "equipment_id", "timestamp", "value"), ["timestamp", "event_id"], 10))


def q_last_reading(spark, sf_dir):
    """Temperature and wear of each equipment's last reading."""
    return finish(last_row_per_group(_rd(spark, sf_dir), "equipment_id", ["timestamp", "event_id"], ["temperature", "tool_wear"]))


def q_group_max(spark, sf_dir):
    """Every reading with the largest wear of its equipment."""
    out = features.group_max_over(_rd(spark, sf_dir), "equipment_id", "tool_wear", "max_wear")
    return finish(out.select("event_id", "equipment_id", "tool_wear", "max_wear"))


def q_latest_predictions(spark, sf_dir):
    """The last score of each equipment from the history."""
    from vigil.operators.fleet import score_batch
    sc = score_batch(_rd(spark, sf_dir))
    return finish(latest_predictions(sc, "equipment_id", "timestamp", ["health_score", "failure_probability"]))


def q_union_tables(spark, sf_dir):
    """Frames with different columns, matched by name; missing ones are NULL."""
    rd = _rd(spark, sf_dir)
    a = rd.filter("event_type = 'view'").select("event_id", "temperature")
    b = rd.filter("event_type <> 'view'").select("vibration", "event_id")
    return finish(concat_frames([a, b]))


def q_scoring_requests(spark, sf_dir):
    """S09 + R06: readings as requests; those that lack a sensor are rejected with its name, a missing id is ``unknown``."""
    rd = _rd(spark, sf_dir, gaps=True)
    rd = rd.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("equipment_id")).alias("equipment_id"), *EVENT_SENSORS)
    good, bad = split_requests(rd, EVENT_SENSORS)
    from vigil.functions.rules import default_equipment_id
    return finish(good.select("event_id", default_equipment_id("equipment_id").alias("equipment_id"), F.lit("").alias("missing")).unionByName(
        bad.select("event_id", default_equipment_id("equipment_id").alias("equipment_id"), F.concat_ws(",", "missing").alias("missing"))))


# --- splits, models, series -------------------------------------------------------

def q_split_plain(spark, sf_dir):
    """Sizes of the split without strata."""
    od = read_table(spark, sf_dir, "orders", ["o_orderkey"])
    return finish(split.split_sizes(split.split(od, "o_orderkey")))


def q_split_singletons(spark, sf_dir):
    """Strata of which many hold one order; those train."""
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return finish(split.split_sizes(split.split(od, "o_orderkey", strata="o_custkey"), "o_custkey"))


def q_regression_report(spark, sf_dir):
    """A19 + A20: MAE, RMSE and R2 of a fixed arithmetic prediction of the quantity."""
    li = read_table(spark, sf_dir, "lineitem", ["l_quantity", "l_extendedprice"])
    li = li.select(F.col("l_quantity").cast("double").alias("rul"), (F.col("l_extendedprice").cast("double") / 1500.0 + 1.0).alias("prediction"))
    return finish(ml.regression_metrics(li))


def q_feature_importance(spark, sf_dir):
    """The correlations of each sensor with the failure probability."""
    from vigil.operators.fleet import score_batch
    sc = score_batch(_rd(spark, sf_dir))
    return finish(ml.feature_importance_view(series.corr_matrix(sc, (*EVENT_SENSORS, "failure_probability"))))


def q_degradation_linear(spark, sf_dir):
    """W05, linear twin: min(position / 800, 1) per equipment."""
    rd = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id"]).select(
        "event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"))
    out = features.degradation_linear(rd, "equipment_id", "timestamp", ["event_id"])
    return finish(out.select("event_id", "equipment_id", "degradation_linear"))


def q_rolling_repeated_ids(spark, sf_dir):
    """W09 with sums and minima over 8 hours; the row ids count from 1 within each equipment, so they repeat."""
    rd = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"]).select(
        "event_id", F.col("ts").alias("timestamp"), F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")).alias("equipment_id"), "value")
    rd = features.with_positions(rd, "equipment_id", "timestamp", ["event_id"], out="line")
    out = series.rolling_features(rd, ["value"], 8 * 3600, "equipment_id", "timestamp", "line", stats=("sum", "min", "count"))
    return finish(out.select("event_id", "value_roll_sum", "value_roll_min", "value_roll_count"))


def q_cooldown_repeated_ids(spark, sf_dir):
    """W07 + maintenance rows with row ids that repeat across equipment and one series without an equipment."""
    rd = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"]).select(
        "event_id", F.col("ts").alias("timestamp"), F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")).alias("equipment_id"),
        (F.col("event_type") == "error").alias("failure_imminent"), "value")
    rd = features.with_positions(rd, "equipment_id", "timestamp", ["event_id"], out="line")
    em = series.cooldown_events(rd, F.col("value") > 20.0, "equipment_id", "timestamp", "line", 5 * 24 * 3600)
    return finish(series.maintenance_from_cooldown(em))


def q_window_means(spark, sf_dir):
    """T05, batch twin: means, extremes and counts of sliding 8-hour windows, every 4 hours."""
    from vigil.streaming.jobs import sliding_windows
    rd = _rd(spark, sf_dir)
    out = sliding_windows(rd, ["temperature"], "8 hours", "4 hours")
    return finish(out.select(F.col("window.start").alias("window_start"), "equipment_id", "temperature_mean", "temperature_min", "temperature_max", "n"))


def q_alert_digests(spark, sf_dir):
    """The immediate list (each exceeding reading) and the daily counts, by kind."""
    from vigil.functions import rules as R
    rd = _rd(spark, sf_dir)
    thresholds = {s: R.ALERT_THRESHOLDS[s] for s in ("temperature", "vibration", "tool_wear")}
    now = quality.exceeding_readings(rd, thresholds, ["event_id", "equipment_id", "timestamp"]).groupBy("sensor").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value")).select(F.lit("immediate").alias("kind"), "sensor", "n", "max_value")
    daily = quality.threshold_exceedances(rd, thresholds, "1 day").groupBy("sensor").agg(
        F.sum("n").alias("n"), F.max("max_value").alias("max_value")).select(F.lit("daily").alias("kind"), "sensor", "n", "max_value")
    return finish(now.unionByName(daily))


def q_action_lines(spark, sf_dir):
    """Title and lines of every reading's action plan."""
    from vigil.functions import rules as R
    from vigil.operators.fleet import score_batch
    sc = score_batch(_rd(spark, sf_dir))
    return finish(sc.select("event_id", R.action_plan("health_score").alias("title"), F.concat_ws("; ", R.action_lines("health_score")).alias("lines")))


def queries() -> dict:
    return {k[2:]: f for k, f in globals().items() if k.startswith("q_")}


# --- SQL --------------------------------------------------------------------------

def oracle_sql() -> dict[str, str]:
    from vigil.functions import rules as R
    from vigil.plans.oracle import _ev, _ranges_union, _scored
    rd, gaps, sensors = "WITH " + _ev(), "WITH " + _ev(True), EVENT_SENSORS
    flag = {c: f"CASE WHEN k % {n} = 0 THEN 1 ELSE 0 END" for c, n in (("TWF", 2), ("HDF", 3), ("PWF", 5), ("OSF", 7), ("RNF", 11))}

    def bad(source: str) -> str:
        longs = "\nUNION ALL\n".join(f"SELECT event_id, equipment_id, '{c}' AS sensor, {c} AS value FROM rd" for c in sensors)
        return f"""{source},
rg AS {_ranges_union('rd', sensors, 1.0)},
lg AS ({longs}),
w AS (SELECT event_id, equipment_id || ': ' || warning AS flat, warning FROM (SELECT *, printf('%s=%s outside expected range [%.2f, %.2f]', sensor, CAST(value AS VARCHAR), mn, mx) AS warning
      FROM lg JOIN rg USING (sensor) WHERE value < mn OR value > mx))"""

    failure = "CASE " + " ".join(f"WHEN {flag[c]} = 1 THEN '{t}'" for c, t in normalize.FAILURE_TYPES) + f" ELSE '{normalize.NO_FAILURE}' END"
    stat = lambda c: (f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, round(max({c}), 6) AS {c}_max, round(min({c}), 6) AS {c}_min")
    basic = ", ".join(f"round(coalesce({s}, 0.0), 6) AS {s}{t}" for s in ("vibration", "temperature", "tool_wear") for t in ("", "_mean", "_max", "_min"))
    corr = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, failure_probability), 6) AS importance FROM sc" for c in (*sensors, "failure_probability"))
    cooldown_src = """SELECT event_id, ts, CASE WHEN user_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS equipment_id,
      event_type = 'error' AS failing, value FROM events"""
    return {
        "validated_readings": bad(gaps) + """
SELECT rd.event_id, CAST(count(warning) AS BIGINT) AS n_warnings, coalesce(string_agg(warning, '; ' ORDER BY warning), '') AS warnings
FROM rd LEFT JOIN w ON w.event_id = rd.event_id GROUP BY rd.event_id""",
        "warning_totals": bad(rd) + """
SELECT (SELECT count(*) FROM rd) AS readings, count(DISTINCT event_id) AS with_warnings, CAST(count(*) AS BIGINT) AS warnings,
  count(*) AS flat_rows, count(DISTINCT flat) AS flat_distinct FROM w""",
        "feature_columns": f"{rd} SELECT equipment_id, {stat('vibration')}, {stat('current')} FROM rd GROUP BY equipment_id",
        "prepare_xy": gaps + """,
f AS (SELECT equipment_id, stddev_samp(temperature) AS s, min(value) AS m FROM rd GROUP BY 1),
l AS (SELECT equipment_id, greatest(0.0, (1.0 - tool_wear / 300.0) * 1000.0) AS rul FROM rd
      QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY "timestamp" DESC, event_id DESC) = 1)
SELECT equipment_id, round(coalesce(s, 0.0), 6) AS temperature_std, round(CASE WHEN m > 0.5 THEN m ELSE 0.0 END, 6) AS value_min, round(rul, 6) AS rul
FROM f JOIN l USING (equipment_id) WHERE rul > 100.0""",
        "sensor_aliases": f"""{rd}
SELECT sensor, round(mn, 6) AS "min", round(mx, 6) AS "max", round(mean, 6) AS mean, round(std, 6) AS std
FROM {_ranges_union('rd', ('vibration', 'temperature', 'current', 'rpm'), 3.0)} r""",
        "basic_vector": f"{gaps} SELECT event_id, {basic}, CAST(0.0 AS DOUBLE) AS feature_12, CAST(0.0 AS DOUBLE) AS feature_13, CAST(0.0 AS DOUBLE) AS feature_14 FROM rd",
        "ai4i_normalize": f"""{rd}
SELECT strftime(TIMESTAMP '2020-01-01' + to_hours(CAST(event_id AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS "timestamp", 'Machine_' || equipment_id AS equipment_id,
  round(temperature / 100.0, 6) AS vibration, round(temperature + 10, 6) AS temperature, round(CAST(rpm AS BIGINT) / 10.0, 6) AS pressure, round(current, 6) AS current,
  CAST(CAST(rpm AS BIGINT) AS DOUBLE) AS rpm, CAST(tool_wear AS BIGINT) AS tool_wear, round(least(tool_wear / 200.0, 1.0), 6) AS degradation_level,
  event_type = 'error' AS failure_imminent, {failure} AS failure_type FROM rd""",
        "ai4i_normalize_v1": f"""{rd}
SELECT CASE WHEN event_id // 24 + 1 <= 31 THEN strftime(TIMESTAMP '2020-01-01' + to_hours(CAST(event_id AS INTEGER)), '%Y-%m-%d %H:%M:%S') END AS "timestamp",
  'Machine_' || equipment_id AS equipment_id, round(temperature / 100.0, 6) AS vibration, round(temperature + 10, 6) AS temperature, round(CAST(rpm AS BIGINT) / 10.0, 6) AS pressure,
  round(current, 6) AS current, CAST(CAST(rpm AS BIGINT) AS DOUBLE) AS rpm, round(tool_wear / (SELECT max(tool_wear) FROM rd), 6) AS degradation_level, event_type = 'error' AS failure_imminent
FROM rd""",
        "ai4i_maintenance": f"""{rd}
SELECT strftime(TIMESTAMP '2020-01-01' + to_hours(CAST(event_id AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS "timestamp", 'Machine_' || equipment_id AS equipment_id,
  'corrective' AS maintenance_type, 'Failure: ' || {failure} AS description, 'bearings, tools' AS parts_replaced, 'Tech_01' AS technician, CAST(8.0 AS DOUBLE) AS downtime_hours
FROM rd WHERE event_type = 'error'""",
        "outlier_report": rd + """,
a AS (SELECT * FROM rd, (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM rd) WHERE abs((value - mu) / sd) < 1.5),
b AS (SELECT a.* FROM a, (SELECT avg(k) AS mu2, stddev_pop(k) AS sd2 FROM a) WHERE abs((k - mu2) / sd2) < 1.5)
SELECT CAST(n AS BIGINT) AS rows_in, CAST(m AS BIGINT) AS rows_out, CAST(n - m AS BIGINT) AS removed FROM (SELECT count(*) AS n FROM rd), (SELECT count(*) AS m FROM b)""",
        "distinct_equipment": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS equipment_id FROM events",
        "invalid_timestamps": 'SELECT count(*) FILTER (WHERE event_id % 13 = 0) AS invalid_timestamps, count(*) AS "rows" FROM events',
        "preview": 'SELECT event_id, CAST(user_id AS VARCHAR) AS equipment_id, ts AS "timestamp", round(value, 6) AS value FROM events ORDER BY ts, event_id LIMIT 10',
        "last_reading": f"""{rd} SELECT equipment_id, round(temperature, 6) AS temperature, round(tool_wear, 6) AS tool_wear FROM rd
QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY "timestamp" DESC, event_id DESC) = 1""",
        "group_max": f"{rd} SELECT event_id, equipment_id, round(tool_wear, 6) AS tool_wear, round(max(tool_wear) OVER (PARTITION BY equipment_id), 6) AS max_wear FROM rd",
        "latest_predictions": "WITH " + _scored() + """
SELECT equipment_id, round(arg_max(health_score, "timestamp"), 6) AS health_score, round(arg_max(failure_probability, "timestamp"), 6) AS failure_probability FROM sc GROUP BY 1""",
        "union_tables": f"""{rd} SELECT event_id, round(CASE WHEN event_type = 'view' THEN temperature END, 6) AS temperature,
  round(CASE WHEN event_type <> 'view' THEN vibration END, 6) AS vibration FROM rd""",
        "scoring_requests": f"""{gaps}
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN equipment_id ELSE 'unknown' END AS equipment_id,
  concat_ws(',', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in sensors)}) AS missing FROM rd""",
        "split_plain": """
SELECT 'test' AS split, CAST(ceil(0.2 * count(*)) AS BIGINT) AS n FROM orders UNION ALL SELECT 'train', CAST(count(*) - ceil(0.2 * count(*)) AS BIGINT) FROM orders""",
        "split_singletons": """
WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT o_custkey, n, CASE WHEN n > 1 THEN CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) ELSE 0 END AS k FROM s)
SELECT o_custkey, 'test' AS split, k AS n FROM t WHERE k > 0 UNION ALL SELECT o_custkey, 'train', n - k FROM t WHERE n > k""",
        "regression_report": """
WITH x AS (SELECT CAST(l_quantity AS DOUBLE) AS y, CAST(l_extendedprice AS DOUBLE) / 1500.0 + 1.0 AS p FROM lineitem)
SELECT round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(1.0 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)), 6) AS r2 FROM x""",
        "feature_importance": "WITH " + _scored() + "\n" + corr,
        "degradation_linear": """
SELECT event_id, CAST(user_id AS VARCHAR) AS equipment_id,
  round(least((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 800.0, 1.0), 6) AS degradation_linear FROM events""",
        "rolling_repeated_ids": """
WITH e AS (SELECT event_id, ts, CASE WHEN user_id % 5 <> 0 THEN user_id END AS u, value FROM events)
SELECT event_id, round(sum(value) OVER w, 6) AS value_roll_sum, round(min(value) OVER w, 6) AS value_roll_min, CAST(count(value) OVER w AS BIGINT) AS value_roll_count
FROM e WINDOW w AS (PARTITION BY u ORDER BY epoch_us(ts) RANGE BETWEEN 28799999999 PRECEDING AND CURRENT ROW)""",
        "cooldown_repeated_ids": f"""
WITH RECURSIVE rd AS ({cooldown_src}),
c AS (SELECT event_id, coalesce(equipment_id, '-') AS e, equipment_id, ts, failing FROM rd WHERE value > 20.0),
st AS (SELECT coalesce(equipment_id, '-') AS e, min(ts) + INTERVAL 5 DAY AS probe FROM rd GROUP BY 1),
first_e AS (SELECT arg_min(c.event_id, c.ts) AS event_id FROM st JOIN c ON st.e = c.e AND c.ts > probe GROUP BY st.e),
nx AS (SELECT a.event_id, arg_min(b.event_id, b.ts) AS nxt FROM c a JOIN c b ON a.e = b.e AND b.ts > a.ts + INTERVAL 5 DAY GROUP BY a.event_id),
chain(event_id) AS (SELECT event_id FROM first_e UNION ALL SELECT nx.nxt FROM chain JOIN nx ON nx.event_id = chain.event_id)
SELECT c.ts AS "timestamp", c.equipment_id, CASE WHEN failing THEN 'corrective' ELSE 'preventive' END AS maintenance_type FROM chain JOIN c USING (event_id)""",
        "window_means": f"""{rd},
x AS (SELECT equipment_id, temperature, unnest([time_bucket(INTERVAL 4 HOUR, "timestamp"), time_bucket(INTERVAL 4 HOUR, "timestamp") - INTERVAL 4 HOUR]) AS window_start FROM rd)
SELECT window_start, equipment_id, round(avg(temperature), 6) AS temperature_mean, round(min(temperature), 6) AS temperature_min, round(max(temperature), 6) AS temperature_max, count(*) AS n
FROM x GROUP BY 1, 2""",
        "alert_digests": f"""{rd},
l AS (SELECT 'temperature' AS sensor, temperature AS value, 314.0 AS t FROM rd UNION ALL SELECT 'vibration', vibration, 3.06 FROM rd UNION ALL SELECT 'tool_wear', tool_wear, 250.0 FROM rd)
SELECT kind, sensor, CAST(count(*) AS BIGINT) AS n, round(max(value), 6) AS max_value FROM l, (SELECT unnest(['immediate', 'daily']) AS kind) WHERE value > t GROUP BY 1, 2""",
        "action_lines": "WITH " + _scored() + """,
t AS (SELECT event_id, CASE WHEN health_score >= 80 THEN 'Normal Operation' WHEN health_score >= 60 THEN 'Monitoring Required'
      WHEN health_score >= 40 THEN 'Immediate Attention Needed' ELSE 'Emergency Shutdown Recommended' END AS title FROM sc)
SELECT event_id, title, CASE title """ + " ".join(f"WHEN '{k}' THEN '{'; '.join(v)}'" for k, v in R.ACTION_LINES.items()) + """ END AS lines FROM t""",
        "rf_train_score": """
WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events)
SELECT 'test' AS split, CAST(ceil(0.2 * n) AS BIGINT) AS n, true AS in_range, true AS beats_mean FROM n
UNION ALL SELECT 'train', CAST(n - ceil(0.2 * n) AS BIGINT), true, true FROM n""",
    }
