"""Whole jobs end to end from CSV files."""
import os

from pyspark.sql import functions as F

from vigil.operators import fleet
from vigil.plans import jobs
from vigil.plans.readings import event_readings
from vigil.sources import files
from tests.conftest import SF_SMALL


def _write_csv(df, path):
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def test_train_job_from_csv(spark, tmp_dir):
    rd = event_readings(spark, SF_SMALL, gaps=True)
    sensor = rd.filter(F.col("event_type") != "view").select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "equipment_id",
        "vibration", "temperature", "pressure", "current", "rpm", "degradation_level", "failure_imminent")
    oper = rd.filter(F.col("event_type") == "view").select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "equipment_id",
        F.col("value").alias("production_rate"), F.lit("A").alias("shift"), F.lit("OP_001").alias("operator_id"),
        F.lit(20.0).alias("ambient_temperature"), F.lit(50.0).alias("ambient_humidity"),
        F.lit("Type_A").alias("product_type"))
    paths = {k: os.path.join(tmp_dir, k) for k in ("sensor", "maintenance", "operational")}
    _write_csv(sensor, paths["sensor"])
    _write_csv(oper, paths["operational"])
    _write_csv(sensor.filter("failure_imminent").select(
        "timestamp", "equipment_id", F.lit("corrective").alias("maintenance_type"),
        F.lit("x").alias("description"), F.lit("y").alias("parts_replaced"), F.lit("T").alias("technician"),
        F.lit(8.0).alias("downtime_hours")), paths["maintenance"])
    ds = files.load_all(spark, paths["sensor"], paths["maintenance"], paths["operational"])
    assert ds.sensor.schema["timestamp"].dataType.simpleString() == "timestamp"
    out = os.path.join(tmp_dir, "out")
    res = jobs.train_job(spark, ds, out, jobs.JobConfig(trees=10, depth=4))
    assert set(res.metrics) == {"mae", "rmse", "r2"}
    feats = spark.read.parquet(os.path.join(out, "features"))
    assert "production_rate_mean" in feats.columns and feats.count() > 0
    back = jobs.ml.TrainedModel.load(spark, os.path.join(out, "model"))
    assert back.feature_columns == res.model.feature_columns


def test_fleet_report_and_profile(spark, tmp_dir):
    sc = fleet.score_batch(event_readings(spark, SF_SMALL, with_degradation=False))
    rep = jobs.fleet_report(sc, os.path.join(tmp_dir, "fleet"))
    assert rep["tiers"].count() == 4 and rep["summary"].count() == 1
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "fleet", "batch_analysis_results")).count() \
        == sc.count()
    prof = jobs.profile_job(event_readings(spark, SF_SMALL))
    assert prof["profile"].first()["record_count"] == sc.count()
    assert {r["column"] for r in prof["failure_rates"].collect()} == {"failure_imminent"}


def test_dataset_job_ai4i(spark, tmp_dir):
    from tests.test_quality_io import AI4I_HEADER
    rows = []
    for i in range(1, 121):
        fail = 1 if i % 9 == 0 else 0
        rows.append(f"{i},M{14000 + i % 12},M,{298 + i % 5 / 10},{308 + i % 7 / 10},{1400 + i * 3},"
                    f"{40 + i % 11},{i % 240},{fail},{fail},0,0,0,0")
    p = os.path.join(tmp_dir, "ai4i.csv")
    with open(p, "w") as f:
        f.write("\n".join([AI4I_HEADER, *rows]) + "\n")
    out = jobs.dataset_job(spark, "ai4i2020", os.path.join(tmp_dir, "run"), jobs.JobConfig(trees=5, depth=3),
                           path=p)
    assert out["profile"]["record_count"] == "120"
    rng = files.read_ranges_json(spark, os.path.join(tmp_dir, "run", "expected_ranges"))
    assert {r["sensor"] for r in rng.collect()} >= {"vibration", "temperature", "tool_wear"}


def test_concat_frames(spark):
    a = spark.createDataFrame([(1, 2.0)], "id long, x double")
    b = spark.createDataFrame([(2, "q")], "id long, y string")
    got = files.concat_frames([a, b]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 2.0, None), (2, None, "q")]


def test_one_pass_reports_equal_separate_aggregates(spark):
    sc = fleet.score_batch(event_readings(spark, SF_SMALL, with_degradation=False))
    rep = fleet.reports_from_aggregates(fleet.fleet_aggregates(sc))

    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())

    assert rows(rep["tiers"]) == rows(fleet.health_tiers(sc))
    assert rows(rep["risk_matrix"]) == rows(fleet.risk_matrix(sc).select("risk_level", "impact_level", "n"))
    assert rows(rep["histogram"]) == rows(fleet.prob_histogram(sc).select("bucket", "n", "lower_edge", "upper_edge"))
    assert rows(rep["summary"]) == rows(fleet.fleet_summary(sc))
