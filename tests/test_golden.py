"""Identities on the reference's committed artefacts (SURVEY §5 (c)); the numbers are fixed test data."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigil.operators import features, quality

# fixed values: committed simple-feature rows (equipment, vibration_mean, rul)
SIMPLE_ROWS = [
    ("EQ_001", 4.0397657342886975, 596.0234265711302),
    ("EQ_002", 4.039906763630309, 596.009323636969),
    ("EQ_003", 4.036124167337292, 596.3875832662709),
    ("EQ_004", 4.037481517415972, 596.2518482584028),
    ("EQ_005", 4.034949032389995, 596.5050967610005),
]
# fixed values: committed expected ranges (sensor, min, max, mean, std)
RANGES = [
    ("vibration", 2.9400415395125274, 3.060057060487472, 3.0000492999999997, 0.020002586829157485),
    ("temperature", 305.55435734250284, 314.45676265749717, 310.00556, 1.4837342191657208),
    ("pressure", 100.09238122597202, 207.662838774028, 153.87761, 17.92840959134266),
    ("current", 10.080108824635985, 69.893711175364, 39.986909999999995, 9.968933725121337),
    ("rpm", 1000.9238122597203, 2076.62838774028, 1538.7761, 179.2840959134266),
    ("tool_wear", 0.0, 298.913439909909, 107.951, 63.654146636636355),
]
# fixed values: committed feature template, in order
TEMPLATE = [f"{b}_{s}" for b in ("vibration", "temperature", "pressure", "current", "rpm", "tool_wear",
                                 "production_rate", "ambient_temperature", "ambient_humidity")
            for s in ("mean", "std", "max", "min")]


def test_simple_rul_identity(spark):
    df = spark.createDataFrame([(e, v) for e, v, _ in SIMPLE_ROWS], "equipment_id string, vibration_mean double")
    rul = F.greatest(features.SIMPLE_RUL_BASE - F.col("vibration_mean") * features.SIMPLE_RUL_VIB_RATE,
                     F.lit(features.SIMPLE_RUL_FLOOR))
    got = {r["equipment_id"]: r["rul"] for r in df.select("equipment_id", rul.alias("rul")).collect()}
    for e, _, r in SIMPLE_ROWS:
        assert got[e] == pytest.approx(r, abs=1e-9)


def test_range_identity():
    for name, lo, hi, mean, std in RANGES:
        assert lo == pytest.approx(max(0.0, mean - quality.RANGE_SIGMAS * std), abs=1e-9), name
        assert hi == pytest.approx(mean + quality.RANGE_SIGMAS * std, abs=1e-9), name


def test_feature_names_follow_template(spark):
    # the cleaned table after the as-of join: sensor (AI4I form) then operational columns
    cols = ("timestamp timestamp, equipment_id string, vibration double, temperature double, pressure double, "
            "current double, rpm double, tool_wear long, degradation_level double, failure_imminent boolean, "
            "failure_type string, production_rate double, shift string, operator_id string, "
            "ambient_temperature double, ambient_humidity double")
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), "Machine_1", 3.0, 310.0, 150.0, 40.0, 1500.0, 10,
                                 0.05, False, "No Failure", 90.0, "A", "OP_001", 20.0, 50.0)], cols)
    feats = features.equipment_features(df)
    assert feats.columns == ["equipment_id", *TEMPLATE]
