"""Scalar rules at their boundaries (FIXTURES §2 and §4)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigil.functions import rules as R
from vigil.operators.fleet import score_batch


def test_recommendation_boundaries(spark):
    ruls = [0, 23, 24, 100, 101, 167, 168, 500, 501, 600, 601, 800, 801, 1000, 20000]
    df = spark.createDataFrame([(float(r),) for r in ruls], "raw double")
    r = R.clamp_rul("raw")
    p = R.probability_from_rul(r)
    got = {row["raw"]: row["rec"] for row in df.select("raw", R.recommendation(r, p).alias("rec")).collect()}
    for x in (0, 23):
        assert got[x].startswith("CRITICAL")
    for x in (24, 100, 101, 167):
        assert got[x].startswith("HIGH")
    for x in (168, 500, 501, 600):
        assert got[x].startswith("MEDIUM")
    for x in (601, 800):
        assert got[x].startswith("HIGH")
    for x in (801, 1000, 20000):
        assert got[x].startswith("CRITICAL")
    assert not any(v.startswith("LOW") for v in got.values())


def test_clamp_probability_confidence(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-5.0,), (50.0,), (101.0,), (501.0,), (20000.0,)],
                               "raw double")
    r = R.clamp_rul("raw")
    rows = df.select("raw", r.alias("rul"), R.probability_from_rul(r).alias("p"),
                     R.confidence(r).alias("c")).collect()
    out = [(x["rul"], x["p"], x["c"]) for x in rows]
    assert out[0] == (0.0, 0.95, 0.65)          # NULL → 0 → prob .95
    assert out[1] == (0.0, 0.95, 0.65)          # NaN → 0
    assert out[2] == (0.0, 0.95, 0.65)
    assert out[3] == (50.0, 0.05, 0.65)
    assert out[4] == (101.0, 0.101, 0.75)
    assert out[5] == (501.0, 0.501, 0.85)
    assert out[6] == (10000.0, 0.95, 0.85)


def test_failure_date(spark):
    df = spark.createDataFrame([(1.5,)], "rul double")
    got = df.select(R.failure_date("rul", "2024-01-01 00:00:00").alias("d")).first()["d"]
    assert got == dt.datetime(2024, 1, 1, 1, 30)


CASES = {  # FIXTURES §2: (vib, temp, press, current, rpm, wear) → (health, p, rul, priority)
    "normal": ((3.0, 310, 150, 40, 1500, 100), (90.0, 0.3, 300.0, "low")),
    "second": ((3.02, 311, 160, 45, 1600, 120), (61.0, 0.61, 260.0, "medium")),
    "warning": ((3.04, 312, 180, 55, 1800, 180), (23.0, 0.95, 140.0, "high")),
    "critical": ((3.06, 314, 200, 65, 2000, 250), (0.0, 0.95, 0.0, "high")),
    "out_of_range": ((0.5, 70, 100, 10, 3000, 200), (0.0, 0.95, 100.0, "high")),
    "machine_2": ((3.5, 315, 170, 45, 1600, 180), (0.0, 0.95, 140.0, "high")),
    "machine_3": ((2.8, 305, 140, 35, 1450, 50), (0.0, 0.95, 400.0, "high")),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_batch_heuristic(spark, name):
    x, (h, p, rul, pr) = CASES[name]
    df = spark.createDataFrame([tuple(float(v) for v in x)],
                               "vibration double, temperature double, pressure double, current double, "
                               "rpm double, tool_wear double")
    row = score_batch(df).first()
    assert row["health_score"] == pytest.approx(h, abs=1e-9)
    assert row["failure_probability"] == pytest.approx(p, abs=1e-9)
    assert row["predicted_rul_hours"] == pytest.approx(rul)
    assert row["maintenance_priority"] == pr


def test_batch_null_vibration(spark):
    df = spark.createDataFrame([(None, 310.0, 150.0, 40.0, 1500.0, 100.0)],
                               "vibration double, temperature double, pressure double, current double, "
                               "rpm double, tool_wear double")
    row = score_batch(df).first()
    assert (row["health_score"], row["failure_probability"], row["predicted_rul_hours"],
            row["maintenance_priority"]) == (0.0, 0.95, 300.0, "high")


def test_tiers_and_labels(spark):
    df = spark.createDataFrame([(x,) for x in (100.0, 80.0, 79.9, 60.0, 40.0, 39.9, 0.0)], "h double")
    got = [r[0] for r in df.select(R.health_tier("h")).collect()]
    assert got == ["Excellent", "Excellent", "Good", "Good", "Fair", "Poor", "Poor"]
    grid = [r[0] for r in df.select(R.grid_status("h")).collect()]
    assert grid == ["green", "yellow", "yellow", "orange", "red", "red", "red"]  # strict >


def test_card_class_high_is_normal(spark):
    df = spark.createDataFrame([(R.REC_CRITICAL,), (R.REC_HIGH,), (R.REC_MEDIUM,)], "r string")
    got = [x[0] for x in df.select(R.card_class("r")).collect()]
    assert got == [R.CARD_IMMEDIATE, R.CARD_NORMAL, R.CARD_SCHEDULE]
    got2 = [x[0] for x in df.select(R.card_class("r", high_branch=True)).collect()]
    assert got2[1] == R.CARD_SCHEDULE


def test_failure_keyword(spark):
    df = spark.createDataFrame([("Tool Wear Failure",), ("No Failure",), ("broken belt",), ("ok",), (None,)],
                               "t string")
    got = [r[0] for r in df.select(R.failure_keyword("t")).collect()]
    assert got == [True, False, True, False, None]


def test_sensor_bands_and_response_targets(spark):
    df = spark.createDataFrame([(3.0,), (3.02,), (3.05,), (3.07,), (None,)], "v double")
    got = [r[0] for r in df.select(R.sensor_band("v", "vibration")).collect()]
    assert got == ["normal", "warning", "normal", "critical", None]
    sev = spark.createDataFrame([("critical",), ("High",), ("medium",), ("low",), ("x",)], "s string")
    got = [r[0] for r in sev.select(R.response_target("s")).collect()]
    assert got == ["24 hours", "1 week", "2-4 weeks", "Next scheduled maintenance", None]


def test_py_float_text_matches_python(spark):
    vals = [0.5, 3.0, 3.06, 310.0, 1e7, 2.5e7, 12345678.9, 1e15, 9.99e15, 1e16, 1.5e17, 1e22,
            0.001, 0.0005, 0.0001, 0.00012, 1e-05, 1.5e-05, -2.5e7, -0.0005, -3.25, 0.0, 123456.789]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(R.py_float_text("v")).collect()]
    assert got == [str(v) for v in vals]


def test_inverse_risk_option(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (990.0,), (2000.0,)], "r double")
    ref = [x[0] for x in df.select(R.probability_from_rul("r")).collect()]
    inv = [x[0] for x in df.select(R.probability_from_rul("r", "inverse")).collect()]
    assert ref == [0.95, 0.1, 0.95, 0.95]
    assert inv == pytest.approx([0.95, 0.9, 0.01, 0.0])
