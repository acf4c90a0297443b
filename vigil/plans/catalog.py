"""Registered queries: one per operator family of SURVEY §2, over the whole test tables.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
match the SQL of the same name in ``oracle``.  Inputs are the driver's tables
re-read through ``readings`` (events → sensor readings, lineitem → a
multi-sensor table, orders → a split population).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import rules as R
from vigil.operators import clean, features, fleet, ml, normalize, profile, quality, series, split
from vigil.operators.asof import asof_join
from vigil.operators.ordered import suggest_bucket_seconds
from vigil.plans import more, stored, streams, whole
from vigil.plans.readings import (EVENT_SENSORS, LINEITEM_SENSORS, event_readings, events_base,
                                  lineitem_readings)
from vigil.plans.util import finish
from vigil.session import cut_lineage
from vigil.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-02-01 00:00:00"
COOLDOWN_THRESHOLD = 0.5
COOLDOWN_GAP_SECONDS = 24 * 3600
RANGE_SIGMAS_TEST = 1.0
ALERT_SENSORS = ("temperature", "vibration", "tool_wear")
CORR_COLUMNS = (*EVENT_SENSORS, "failure_probability")


def _width(df: DataFrame, by: str = "equipment_id", ts: str = "timestamp") -> int:
    """Order-bucket width of the ordered scans, from the densest hour of any key."""
    return suggest_bucket_seconds(df.select(by, ts), by, ts)


def _scored(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    return fleet.score_batch(event_readings(spark, sf_dir, with_degradation=False, gaps=gaps))


# --- A01–A07: features, labels, ranges -------------------------------------

def q_equipment_features(spark, sf_dir):
    """A01 on lineitem: per supplier mean / sample std / max / min of four measures."""
    return finish(features.equipment_features(lineitem_readings(spark, sf_dir), "equipment_id",
                                              LINEITEM_SENSORS))


def q_fleet_features(spark, sf_dir):
    """The same statistics over the whole table (no equipment id)."""
    li = lineitem_readings(spark, sf_dir).select(*LINEITEM_SENSORS)
    return finish(features.equipment_features(li, None, LINEITEM_SENSORS))


def q_equipment_labels(spark, sf_dir):
    """RUL label from the last reading's degradation (tool wear / 300) per user, all readings."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    rd = rd.withColumn("degradation_level", F.col("tool_wear") / 300.0)
    return finish(features.equipment_labels(rd, "equipment_id", ["timestamp", "event_id"]))


def q_heuristic_labels(spark, sf_dir):
    """Table-wide heuristic RUL for every equipment."""
    rd = event_readings(spark, sf_dir, with_degradation=False).select(
        "equipment_id", "vibration", "temperature", "tool_wear")
    return finish(features.heuristic_labels(rd, "equipment_id"))


def q_simple_features(spark, sf_dir):
    """A05 + A06: simple feature row with the temperature trend per equipment."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    return finish(features.simple_features(rd, "equipment_id", "timestamp", ["event_id"], _width(rd)))


def q_temperature_trend(spark, sf_dir):
    """Least-squares slope of temperature on row position per equipment."""
    rd = event_readings(spark, sf_dir, with_degradation=False).select(
        "equipment_id", "timestamp", "event_id", "temperature")
    pos = features.with_positions(rd, "equipment_id", "timestamp", ["event_id"], out="position", bucket_seconds=_width(rd))
    return finish(pos.groupBy("equipment_id").agg(
        features.trend_expr("temperature", "position").alias("temperature_trend"),
        F.count(F.lit(1)).alias("n")))


def q_expected_ranges(spark, sf_dir):
    """A07 on lineitem's four measures (mean ± 3 sample σ, floor 0)."""
    li = lineitem_readings(spark, sf_dir)
    return finish(quality.expected_ranges(li, LINEITEM_SENSORS))


def q_range_warnings(spark, sf_dir):
    """F03 + J05 + A26: readings outside mean ± 1σ ranges of the same readings."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    rng = quality.expected_ranges(rd, EVENT_SENSORS, n_sigma=RANGE_SIGMAS_TEST)
    bad = quality.range_violations(rd, rng, ["event_id", "equipment_id"], EVENT_SENSORS)
    return finish(bad.select("event_id", "equipment_id", "sensor", "value", "warning",
                             F.concat_ws(": ", "equipment_id", "warning").alias("flat_warning")))


def q_critical_readings(spark, sf_dir):
    """R20 + J05: readings above the per-sensor critical thresholds (long form)."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    return finish(quality.critical_readings(rd, ["event_id", "equipment_id"]))


def q_sensor_bands(spark, sf_dir):
    """R21 + R24: documented warning / critical band per reading and sensor, with the response target."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    long = quality.unpivot_sensors(rd, ["event_id", "equipment_id"], list(R.SENSOR_BANDS))
    band = None
    for sensor in R.SENSOR_BANDS:
        b = R.sensor_band(F.col("value"), sensor)
        band = F.when(F.col("sensor") == sensor, b) if band is None else band.when(F.col("sensor") == sensor, b)
    out = long.withColumn("band", band).filter(F.col("band") != "normal")
    sev = F.when(F.col("band") == "critical", F.lit("critical")).otherwise(F.lit("medium"))
    return finish(out.withColumn("response_target", R.response_target(sev)))


def q_failure_maintenance(spark, sf_dir):
    """F02 + P07: one corrective maintenance row per failing reading."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    return finish(normalize.failure_maintenance(rd))


# --- J01, W01/W02, F01, A14: cleaning ----------------------------------------

def q_asof_enrich(spark, sf_dir):
    """Each event that is no view, enriched with the user's last view at or before it."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    left = ev.filter(F.col("event_type") != "view").select("event_id", "ts", "user_id", "value")
    right = ev.filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("view_event_id"), "ts", F.col("ts").alias("view_ts"), "user_id",
        F.col("value").alias("view_value"))
    out = asof_join(left, right, on="ts", by="user_id", left_tiebreak="event_id",
                    right_tiebreak="view_event_id", bucket_seconds=_width(ev, "user_id", "ts"))
    # the matched id is NULL for unmatched rows: returned as text so that no
    # engine's nullable-integer conversion (float vs Int64) changes its value
    return finish(out.withColumn("view_event_id", F.col("view_event_id").cast("string")))


def q_clean_enrich(spark, sf_dir):
    """Interpolate gaps → sequential z-score filter → as-of enrich with operational context.

    Sensor side: every non-view event (value NULL on errors); operational side:
    view events (production rate = value).
    """
    ev = events_base(spark, sf_dir)
    sensor = ev.filter(F.col("event_type") != "view").select(
        "event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "k")
    oper = ev.filter(F.col("event_type") == "view").select(
        F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"),
        F.col("event_id").alias("view_event_id"), F.col("value").alias("production_rate"))
    out = clean.clean_and_preprocess(sensor, oper, "interpolate", tiebreak=["event_id"],
                                     operational_tiebreak=["view_event_id"],
                                     outlier_columns=["value", "k"], bucket_seconds=_width(ev, "user_id", "ts"))
    return finish(out.withColumn("view_event_id", F.col("view_event_id").cast("string")))


def q_interpolate_gaps(spark, sf_dir):
    """W01 + W02: value NULL on error events, filled linearly per user, then back-filled."""
    rd = event_readings(spark, sf_dir, with_degradation=False, gaps=True).select(
        "event_id", "timestamp", "equipment_id", "value")
    out = clean.interpolate_linear(rd, ["value"], by="equipment_id", ts="timestamp",
                                   tiebreak=["event_id"], bucket_seconds=_width(rd))
    return finish(out.select("event_id", "equipment_id", "value"))


def q_zscore_filter(spark, sf_dir):
    """sequential z-score filter over value then k."""
    ev = events_base(spark, sf_dir).select("event_id", "user_id", "value", "k")
    return finish(clean.remove_outliers(ev, ["value", "k"]))


def q_median_impute(spark, sf_dir):
    """NULL values (error events) replaced by the exact table median."""
    ev = events_base(spark, sf_dir)
    ev = ev.select("event_id", "user_id",
                   F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "k")
    return finish(clean.median_impute(ev, ["value"]))


def q_null_report(spark, sf_dir):
    """NULL counts per sensor after the error gaps, and the total."""
    rd = event_readings(spark, sf_dir, with_degradation=False, gaps=True)
    return finish(clean.null_counts(rd, list(EVENT_SENSORS)))


# --- R*, A15–A18, E08: fleet report -------------------------------------------

def q_batch_health(spark, sf_dir):
    """R09 + R10 on event readings."""
    sc = _scored(spark, sf_dir)
    return finish(sc.select("event_id", "equipment_id", "vibration", "temperature", "pressure",
                            "tool_wear", "health_score", "failure_probability",
                            "predicted_rul_hours", "maintenance_priority"))


def q_health_tiers(spark, sf_dir):
    """Tier counts with zero-count tiers."""
    return finish(fleet.health_tiers(_scored(spark, sf_dir)))


def q_risk_matrix(spark, sf_dir):
    """R12 x R13."""
    return finish(fleet.risk_matrix(_scored(spark, sf_dir)))


def q_prob_histogram(spark, sf_dir):
    """20 equal-width buckets on [0, .95]."""
    return finish(fleet.prob_histogram(_scored(spark, sf_dir)))


def q_fleet_summary(spark, sf_dir):
    """A18."""
    return finish(fleet.fleet_summary(_scored(spark, sf_dir)))


def q_fleet_aggregates(spark, sf_dir):
    """E08 one-pass: tiers, risk matrix, histogram and summary as one grouping-sets aggregate."""
    agg = fleet.fleet_aggregates(_scored(spark, sf_dir))
    # the bucket is NULL outside the histogram grouping: returned as DOUBLE so that no
    # engine's nullable-integer conversion changes it
    return finish(agg.withColumn("bucket", F.col("bucket").cast("double")))


def q_fleet_status(spark, sf_dir):
    """Tier shares and alert count."""
    return finish(fleet.fleet_status_shares(_scored(spark, sf_dir)))


def q_rule_labels(spark, sf_dir):
    """R11, R13, R14, R16, R17, R19, R22 on the scored readings."""
    sc = _scored(spark, sf_dir)
    return finish(sc.select(
        "event_id",
        R.decision("failure_probability", "health_score").alias("decision"),
        R.impact_level("health_score").alias("impact_level"),
        R.urgency_label("maintenance_priority").alias("urgency"),
        R.grid_status("health_score").alias("grid_status"),
        R.action_plan("health_score").alias("action_plan"),
        R.health_scale_6("health_score").alias("health_scale"),
        R.health_tier("health_score").alias("health_tier"),
        R.gauge_zone("temperature", "temperature").alias("temperature_zone"),
        R.gauge_zone("pressure", "pressure").alias("pressure_zone"),
        R.gauge_alarm("rpm", "rpm").alias("rpm_alarm"),
        R.health_from_probability("failure_probability").alias("health_from_probability"),
    ))


def q_prediction_rules(spark, sf_dir):
    """R01–R06, R15, R18 with (value - 20) * 60 as the model's RUL: below 0, at 0 for every tenth event,
    NULL for every eleventh, above 10,000; every seventh event has no equipment id."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "value"])
    rul = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 10 == 0, F.lit(0.0)).otherwise(
        (F.col("value") - 20.0) * 60.0)
    base = ev.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("string")).alias("equipment_id"),
                     rul.alias("prediction"))
    res = ml.prediction_result(base, "prediction", as_of=AS_OF)
    rul = R.clamp_rul("prediction")
    return finish(res.select(
        "event_id", "equipment_id", "predicted_rul_hours", "failure_probability", "confidence",
        "maintenance_recommendation", "predicted_failure_date",
        R.days_remaining(rul).alias("days_remaining"), R.rul_band(rul).alias("rul_band"),
        R.card_class("maintenance_recommendation").alias("card_class")))


def q_sensor_corr(spark, sf_dir):
    """Pearson matrix of six sensors and the failure probability."""
    return finish(series.corr_matrix(_scored(spark, sf_dir), CORR_COLUMNS))


def q_sensor_corr_by_equipment(spark, sf_dir):
    """Per-equipment correlation of three sensors."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    return finish(series.corr_matrix(rd, ["temperature", "current", "tool_wear"], by="equipment_id"))


def q_urgent_top(spark, sf_dir):
    """All readings, the most urgent first."""
    sc = _scored(spark, sf_dir)
    top = series.urgent_list(sc, None, "equipment_id", ["event_id"])
    return finish(top.select("event_id", "equipment_id", "maintenance_priority", "priority_rank",
                             "failure_probability", "health_score"))


def q_health_trend_daily(spark, sf_dir):
    """Daily average health with day-over-day change."""
    sc = _scored(spark, sf_dir)
    tr = series.health_trend_daily(sc, "timestamp")
    return finish(tr.select(F.col("day").cast("timestamp").alias("day"), "avg_health", "n", "delta", "tier"))


def q_alert_digest(spark, sf_dir):
    """T02 (batch twin): hourly counts of readings above the alert thresholds."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    thresholds = {s: R.ALERT_THRESHOLDS[s] for s in ALERT_SENSORS}
    g = quality.threshold_exceedances(rd, thresholds, "1 hour")
    return finish(g.select(F.col("window.start").alias("window_start"), "equipment_id", "sensor", "n"))


# --- profile A08–A11 ----------------------------------------------------------

def q_dataset_profile(spark, sf_dir):
    """A08."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    return finish(profile.dataset_profile(rd, "equipment_id", "timestamp"))


def q_failure_rate(spark, sf_dir):
    """A09 + A10 + F07 + F08: rates of the columns named like failures: the flag, a text that holds keywords, plain
    types, ``No Failure`` and NULL, and a number."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    text = F.when(F.col("event_type") == "error", F.lit("Bearing MALFUNCTION")).when(F.col("event_type") == "click", F.lit("No Failure")) \
        .when(F.col("event_type") == "signup", F.lit(None)).when(F.col("event_type") == "view", F.lit("pump failed")).otherwise(F.col("event_type"))
    rd = rd.select("event_id", "failure_imminent", text.alias("failure_text"), (F.col("tool_wear") > 200).cast("int").alias("fail_code"))
    out = profile.failure_rates(rd)
    return finish(out.withColumnRenamed("column", "column_name"))


def q_type_distribution(spark, sf_dir):
    """Top-10 value counts of the event type."""
    ev = read_table(spark, sf_dir, "events", ["event_type"])
    return finish(profile.value_distribution(ev, "event_type"))


def q_numeric_summary(spark, sf_dir):
    """Mean / std of numeric columns not named like targets."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    return finish(profile.numeric_summary(rd).withColumnRenamed("column", "column_name"))


# --- series W05, W07–W09, P05 -------------------------------------------------

def q_cooldown_events(spark, sf_dir):
    """Maintenance emissions when degradation > .5 with a one-day cooldown."""
    rd = event_readings(spark, sf_dir)
    em = series.cooldown_events(rd, F.col("degradation_level") > COOLDOWN_THRESHOLD, "equipment_id",
                                "timestamp", "event_id", COOLDOWN_GAP_SECONDS)
    return finish(em.select("event_id", "equipment_id", "timestamp",
                            F.when(F.col("failure_imminent"), F.lit("corrective"))
                            .otherwise(F.lit("preventive")).alias("maintenance_type")))


def q_daily_spine_asof(spark, sf_dir):
    """W08 + J01: daily points per user enriched with the last reading."""
    rd = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"]).select(
        "event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"),
        "value")
    sp = series.daily_spine(rd, "equipment_id", "timestamp")
    out = series.spine_asof(sp, rd, ["value"], "equipment_id", "timestamp", ["event_id"], _width(rd))
    return finish(out.select("equipment_id", "timestamp", "event_id", "value"))


def q_rolling_features(spark, sf_dir):
    """Trailing 24 h mean / max / count of value per user."""
    rd = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"]).select(
        "event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"),
        "value")
    out = series.rolling_features(rd, ["value"], 24 * 3600, "equipment_id", "timestamp", "event_id")
    return finish(out.select("event_id", "equipment_id", "value_roll_mean", "value_roll_max",
                             "value_roll_count"))


def q_degradation_curve(spark, sf_dir):
    """Progress-based degradation curve per user."""
    rd = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id"]).select(
        "event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("equipment_id"))
    out = features.degradation_curve(rd, "equipment_id", "timestamp", ["event_id"], bucket_seconds=_width(rd))
    return finish(out.select("event_id", "equipment_id", "progress", "degradation_curve", "failing"))


def q_degradation_cmapss(spark, sf_dir):
    """P05 + W04: lineitem as run-to-failure units (unit = supplier, cycle = line number)."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     "l_partkey"])
    raw = li.select(F.col("l_suppkey").alias("unit"), F.col("l_linenumber").alias("cycle"),
                    F.col("l_quantity").alias("sensor_1"), F.col("l_extendedprice").alias("sensor_2"),
                    F.col("l_discount").alias("sensor_3"), F.col("l_tax").alias("sensor_4"),
                    F.col("l_partkey").alias("sensor_5"))
    return finish(normalize.normalize_cmapss(raw))


# --- ML M02, M09, O04/O05, M03–M06 --------------------------------------------

def q_scaler_apply(spark, sf_dir):
    """A21 + M02: standardise lineitem measures with mean / population std."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", *LINEITEM_SENSORS])
    params = ml.fit_scaler(li, LINEITEM_SENSORS)
    return finish(ml.apply_scaler(li, params))


def q_weighted_ensemble(spark, sf_dir):
    """Weighted average of four columns as model outputs."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", *LINEITEM_SENSORS])
    return finish(li.select("l_orderkey", "l_linenumber",
                            ml.weighted_ensemble(LINEITEM_SENSORS).alias("ensemble"),
                            R.relu(F.col("l_discount") - 0.05).alias("relu_discount")))


def q_split_counts(spark, sf_dir):
    """Stratified deterministic split of orders by priority; sizes per side."""
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"])
    sp = split.split(od, "o_orderkey", strata="o_orderpriority")
    return finish(split.split_sizes(sp, "o_orderpriority"))


def q_template_align(spark, sf_dir):
    """Readings aligned to the feature template learnt from the readings' features."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    feats = features.equipment_features(rd.select("equipment_id", *EVENT_SENSORS), "equipment_id")
    template = [c for c in feats.columns if c != "equipment_id"]
    return finish(ml.align_to_template(rd, template, keep=["event_id"]))


def q_rf_train_score(spark, sf_dir):
    """M01–M06 + J03 + O04: the reference's forest (100 trees, depth 10) on simple features.

    Per side: rows, whether every prediction lies in the range of the training labels, and whether the
    mean absolute error is below that of predicting the training mean (A19).
    """
    rd = event_readings(spark, sf_dir, with_degradation=False)
    sf = features.simple_features(rd, "equipment_id", "timestamp", ["event_id"])
    data, xcols = ml.prepare_xy(sf.drop("rul"), sf.select("equipment_id", "rul"), "equipment_id", "rul")
    # several passes (scaler, tree levels, scoring) read it: cut once in the checkpoint folder
    data = cut_lineage(split.split(data, "equipment_id"))
    train = data.filter(F.col("split") == "train")
    tm = ml.train(train, xcols, "rul", ml.forest(n_trees=ml.FOREST_TREES, depth=ml.FOREST_DEPTH))
    bounds = train.agg(F.min("rul").alias("lo"), F.max("rul").alias("hi"), F.avg("rul").alias("mean")).first()
    pred = ml.predict(tm, data)
    error, plain = F.avg(F.abs(F.col("prediction") - F.col("rul"))), F.avg(F.abs(F.lit(bounds["mean"]) - F.col("rul")))
    return finish(pred.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.every(F.col("prediction").between(F.lit(bounds["lo"]) - 1e-6, F.lit(bounds["hi"]) + 1e-6)).alias("in_range"),
        (error < plain).alias("beats_mean")))


def queries() -> dict[str, Query]:
    return {
        "equipment_features": q_equipment_features,
        "fleet_features": q_fleet_features,
        "equipment_labels": q_equipment_labels,
        "heuristic_labels": q_heuristic_labels,
        "simple_features": q_simple_features,
        "temperature_trend": q_temperature_trend,
        "expected_ranges": q_expected_ranges,
        "range_warnings": q_range_warnings,
        "critical_readings": q_critical_readings,
        "sensor_bands": q_sensor_bands,
        "failure_maintenance": q_failure_maintenance,
        "asof_enrich": q_asof_enrich,
        "interpolate_gaps": q_interpolate_gaps,
        "clean_enrich": q_clean_enrich,
        "zscore_filter": q_zscore_filter,
        "median_impute": q_median_impute,
        "null_report": q_null_report,
        "batch_health": q_batch_health,
        "health_tiers": q_health_tiers,
        "risk_matrix": q_risk_matrix,
        "prob_histogram": q_prob_histogram,
        "fleet_summary": q_fleet_summary,
        "fleet_status": q_fleet_status,
        "fleet_aggregates": q_fleet_aggregates,
        "rule_labels": q_rule_labels,
        "prediction_rules": q_prediction_rules,
        "sensor_corr": q_sensor_corr,
        "sensor_corr_by_equipment": q_sensor_corr_by_equipment,
        "urgent_top": q_urgent_top,
        "health_trend_daily": q_health_trend_daily,
        "alert_digest": q_alert_digest,
        "dataset_profile": q_dataset_profile,
        "failure_rate": q_failure_rate,
        "type_distribution": q_type_distribution,
        "numeric_summary": q_numeric_summary,
        "cooldown_events": q_cooldown_events,
        "daily_spine_asof": q_daily_spine_asof,
        "rolling_features": q_rolling_features,
        "degradation_curve": q_degradation_curve,
        "degradation_cmapss": q_degradation_cmapss,
        "scaler_apply": q_scaler_apply,
        "weighted_ensemble": q_weighted_ensemble,
        "split_counts": q_split_counts,
        "template_align": q_template_align,
        "rf_train_score": q_rf_train_score,
    } | more.queries() | stored.queries() | streams.queries() | whole.queries()
