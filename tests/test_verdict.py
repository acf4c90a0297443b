"""Faults of earlier versions, each with the case that showed it."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from vigil import session
from vigil.operators import clean, features, fleet, ml, profile, quality, series, split
from vigil.plans import jobs
from vigil.sources import files
from vigil.streaming import jobs as streaming

T0 = dt.datetime(2024, 1, 1)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_columns_are_found_by_name(spark, tmp_dir):
    plain = _write(f"{tmp_dir}/a.csv", "timestamp,equipment_id,vibration,temperature,pressure,current,rpm,degradation_level,failure_imminent\n"
                   "2024-01-01 00:00:00,M1,1.0,300.0,100.0,10.0,1500.0,0.25,true\n")
    other = _write(f"{tmp_dir}/b.csv", "failure_type,tool_wear,degradation_level,failure_imminent,rpm,current,pressure,temperature,vibration,equipment_id,timestamp\n"
                   "No Failure,120,0.25,true,1500.0,10.0,100.0,300.0,1.0,M1,2024-01-01 00:00:00\n")
    names = [f.name for f in files.SENSOR_SCHEMA]
    a, b = (files.read_csv(spark, p, files.SENSOR_SCHEMA) for p in (plain, other))
    assert a.select(names).collect() == b.select(names).collect()
    assert b.first()["tool_wear"] == "120" and b.first()["degradation_level"] == 0.25 and b.first()["failure_imminent"] is True
    short = _write(f"{tmp_dir}/c.csv", "timestamp,equipment_id\n2024-01-01 00:00:00,M1\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, short, files.SENSOR_SCHEMA)


def test_rul_lines_are_numbered_in_order(spark, tmp_dir):
    path = _write(f"{tmp_dir}/rul.txt", "".join(f"{k * 3}\n" for k in range(1, 301)))
    got = {r.unit: r.rul for r in files.read_cmapss_rul(spark, path).collect()}
    assert got == {k: float(k * 3) for k in range(1, 301)}


def test_requests_without_id_are_scored_and_bad_ones_are_listed(spark):
    rows = [(None, 1.0, 2.0), ("a", None, 2.0), ("b", 1.0, None)]
    good, bad = files.split_requests(spark.createDataFrame(rows, "equipment_id string, vibration double, rpm double"), ["vibration", "rpm"])
    assert [r.equipment_id for r in good.collect()] == [None]
    assert {r.equipment_id: r.missing for r in bad.collect()} == {"a": ["vibration"], "b": ["rpm"]}


def test_median_of_the_widest_and_the_narrowest_range(spark):
    values = [float(k) for k in range(12_000)]
    df = spark.createDataFrame([(v,) for v in [*values, -1e308, 1e308]], "v double")
    assert clean.exact_median(df, "v") == 5999.5
    tiny = [5e-324 * (k % 3) for k in range(9_000)]
    assert clean.exact_median(spark.createDataFrame([(v,) for v in tiny], "v double"), "v") == 5e-324


def test_rolling_and_cooldown_with_ids_that_repeat_and_a_null_equipment(spark):
    rows = [(e, T0 + dt.timedelta(hours=6 * k), k, float(k)) for e in ("a", "b", None) for k in range(12)]
    df = spark.createDataFrame(rows, "equipment_id string, timestamp timestamp, event_id long, v double")
    out = series.rolling_features(df, ["v"], 24 * 3600)
    assert out.count() == 36
    assert {(r.equipment_id, r.event_id): r.v_roll_count for r in out.collect()} == {(e, k): min(k + 1, 4) for e in ("a", "b", None) for k in range(12)}
    got = sorted((str(r.equipment_id), r.event_id) for r in series.cooldown_events(df, F.col("v") >= 0, gap_seconds=24 * 3600).collect())
    assert got == sorted((str(e), k) for e in ("a", "b", None) for k in (5, 10))


def test_empty_tables_give_null_shares(spark):
    empty = spark.createDataFrame([], "health_score double, maintenance_priority string")
    row = fleet.fleet_status_shares(empty).first()
    assert row.healthy_pct is None and row.alerts == 0
    assert profile.failure_rates(spark.createDataFrame([], "failure_text string")).first().failure_rate_pct is None


def test_weights_depth_and_list_are_not_cut(spark):
    with pytest.raises(ValueError):
        ml.weighted_ensemble(["a", "b", "c", "d", "e"])
    with pytest.raises(ValueError):
        ml.forest(depth=31)
    scored = spark.range(50).select(F.col("id").alias("equipment_id"), F.lit("high").alias("maintenance_priority"), (F.col("id") / 50).alias("failure_probability"))
    assert series.urgent_list(scored).count() == 50 and series.urgent_list(scored, 3).count() == 3


def test_model_does_not_depend_on_the_order_of_the_rows(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("equipment_id"), (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 17 * 3 + F.col("id") % 5).cast("double").alias("rul"))
    a, b = (ml.train(d, ["x"], estimator=ml.forest(n_trees=5, depth=4)) for d in (df.repartition(3), df.orderBy(F.desc("x")).repartition(7)))
    pick = lambda m: {r.equipment_id: r.prediction for r in ml.predict(m, df).collect()}
    assert pick(a) == pick(b)


def test_strata_of_one_row_train(spark):
    df = spark.createDataFrame([(k, "one" if k == 0 else "many") for k in range(21)], "k long, s string")
    got = {(r.s, r.split): r.n for r in split.split_sizes(split.split(df, "k", "s"), "s").collect()}
    assert got == {("one", "train"): 1, ("many", "test"): 4, ("many", "train"): 16}


def test_ranges_are_not_broadcast_by_hint(spark):
    df = spark.createDataFrame([(1, 5.0)], "event_id long, vibration double")
    ranges = spark.createDataFrame([("vibration", 0.0, 1.0)], "sensor string, min double, max double")
    out = quality.range_violations(df, ranges, ["event_id"], ["vibration"])
    assert "Hint" not in out._jdf.queryExecution().logical().toString() and out.count() == 1


def test_scratch_folder_only_on_one_machine(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_late_rows_of_the_cooldown_stream_are_dropped(spark, tmp_dir):
    schema = "equipment_id string, timestamp timestamp, event_id long, degradation_level double, failure_imminent boolean"
    src = f"{tmp_dir}/late"
    for k, rows in enumerate([[("a", T0 + dt.timedelta(days=60), 1, 0.1, False)], [("a", T0 + dt.timedelta(days=61), 2, 0.9, False)],
                              [("b", T0, 3, 0.1, False), ("b", T0 + dt.timedelta(days=5), 4, 0.9, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = streaming.cooldown_stream(stream, 0.5, 3600, watermark="1 day").writeStream.format("parquet").option("path", f"{tmp_dir}/out").option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    got = [r.event_id for r in spark.read.parquet(f"{tmp_dir}/out").collect()]
    assert got == [2]


def test_a_replayed_batch_replaces_its_rows(spark, tmp_dir):
    schema = "equipment_id string, timestamp timestamp, event_id long"
    src, out = f"{tmp_dir}/in", f"{tmp_dir}/sink"
    spark.createDataFrame([("a", T0, 1)], schema).write.parquet(src)
    op = spark.createDataFrame([("a", T0, 5.0), ("z", T0, 9.0)], "equipment_id string, timestamp timestamp, production_rate double")
    for folder in ("c1", "c2"):  # a lost checkpoint replays the batch
        streaming.asof_enrich_stream(spark.readStream.schema(schema).parquet(src), op, out, f"{tmp_dir}/{folder}").awaitTermination()
    assert [(r.event_id, r.production_rate) for r in spark.read.parquet(out).collect()] == [(1, 5.0)]


def test_threshold_reaches_the_filter_and_the_cleaned_table_is_written(spark, tmp_dir):
    rows = [("m%d" % (k % 6), T0 + dt.timedelta(hours=k), 100.0 if k == 50 else float(k % 10), 1.0 - k / 200) for k in range(120)]
    sensor = spark.createDataFrame(rows, "equipment_id string, timestamp timestamp, vibration double, degradation_level double")
    kept = {}
    for threshold in (3.0, 50.0):
        out = f"{tmp_dir}/t{threshold}"
        jobs.train_job(spark, files.Dataset(sensor), out, jobs.JobConfig(zscore_threshold=threshold, trees=2, depth=2))
        kept[threshold] = spark.read.parquet(f"{out}/cleaned").count()
    assert kept[50.0] == 120 and kept[3.0] < 120


def test_feature_only_job(spark, tmp_dir):
    path = _write(f"{tmp_dir}/s.csv", "timestamp,equipment_id,vibration,temperature,pressure,current,rpm,degradation_level,failure_imminent\n"
                  + "".join(f"2024-01-0{k} 00:00:00,M{k % 2},1.0,300.0,100.0,10.0,1500.0,0.{k},false\n" for k in range(1, 9)))
    jobs.features_job(spark, path, f"{tmp_dir}/f")
    assert spark.read.parquet(f"{tmp_dir}/f/features").count() == 2
    assert {r.equipment_id: round(r.rul) for r in spark.read.parquet(f"{tmp_dir}/f/labels").collect()} == {"M0": 200, "M1": 300}


def test_handle_missing_template_gbt_and_schema_drift(spark):
    df = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + dt.timedelta(hours=1), None), ("a", T0 + dt.timedelta(hours=2), 3.0)], "equipment_id string, timestamp timestamp, v double")
    assert [r.v for r in clean.handle_missing(df).orderBy("timestamp").collect()] == [1.0, 2.0, 3.0]
    assert [r.v for r in clean.handle_missing(df, "median").orderBy("timestamp").collect()] == [1.0, 2.0, 3.0]
    assert ml.template_frame(spark, ["x", "y"]).collect()[0].asDict() == {"x": 0.0, "y": 0.0}
    assert (ml.gbt().getMaxIter(), ml.gbt().getMaxDepth(), ml.gbt().getStepSize()) == (ml.GBT_ITERATIONS, ml.GBT_DEPTH, ml.GBT_STEP)
    drift = quality.schema_drift(["v", "w"], df)
    assert drift.missing == ["w"] and drift.extra == ["equipment_id", "timestamp"] and not drift.ok


def test_positions_of_a_hot_key_are_dealt_by_bucket(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("equipment_id"), (F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("timestamp"), "id")
    out = features.with_positions(df, "equipment_id", "timestamp", ["id"])
    assert out.filter("position <> id").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 1 and "rangeBetween" not in plan
