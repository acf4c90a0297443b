"""Ranges, validation, split, normalisers, readers and sinks."""
import datetime as dt
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from vigil.operators import ml, normalize, quality, split
from vigil.sources import files

# committed ranges of the reference (FIXTURES §2): fixed values
RANGES = {
    "vibration": (2.9400415395125274, 3.060057060487472),
    "temperature": (305.55435734250284, 314.45676265749717),
    "pressure": (100.09238122597202, 207.662838774028),
    "current": (10.080108824635985, 69.893711175364),
    "rpm": (1000.9238122597203, 2076.62838774028),
    "tool_wear": (0.0, 298.913439909909),
}
READINGS = {
    "normal": (3.0, 310, 150, 40, 1500, 100, 0),
    "second": (3.02, 311, 160, 45, 1600, 120, 0),
    "warning": (3.04, 312, 180, 55, 1800, 180, 0),
    "critical": (3.06, 314, 200, 65, 2000, 250, 0),
    "machine_2": (3.5, 315, 170, 45, 1600, 180, 2),
    "machine_3": (2.8, 305, 140, 35, 1450, 50, 2),
    "out_of_range": (0.5, 70, 100, 10, 3000, 200, 5),
}


def test_validate_ranges_counts(spark):
    rows = [(k, *[float(x) for x in v[:6]]) for k, v in READINGS.items()]
    df = spark.createDataFrame(rows, "equipment_id string, vibration double, temperature double, "
                                     "pressure double, current double, rpm double, tool_wear double")
    out = {r["equipment_id"]: r["data_quality_warnings"]
           for r in quality.validate_ranges(df, RANGES).collect()}
    for k, v in READINGS.items():
        n = 0 if out[k] is None else len(out[k])
        assert n == v[6], k
    assert out["normal"] is None
    assert out["out_of_range"][0] == "vibration=0.5 outside expected range [2.94, 3.06]"
    flat = quality.flatten_warnings(quality.validate_ranges(df, RANGES)).collect()
    assert len(flat) == 9 and flat[0][0].count(": ") >= 1


def test_expected_ranges_identity(spark):
    df = spark.createDataFrame([(float(x), float(x % 7)) for x in range(50)], "vibration double, tool_wear double")
    r = {x["sensor"]: x for x in quality.expected_ranges(df).collect()}
    for s in ("vibration", "tool_wear"):
        assert r[s]["min"] == pytest.approx(max(0.0, r[s]["mean"] - 3 * r[s]["std"]))
        assert r[s]["max"] == pytest.approx(r[s]["mean"] + 3 * r[s]["std"])
    assert r["tool_wear"]["min"] == 0.0


def test_alias_resolution(spark):
    df = spark.createDataFrame([(1.0, "x", 2.0, 3)], "temp double, vibration string, torque double, rpm int")
    assert quality.resolve_sensor_aliases(df) == {"temperature": "temp", "current": "torque", "rpm": "rpm"}


def test_schema_drift(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "b double, a double, z double")
    d = quality.schema_drift(["a", "b", "c"], df)
    assert d.missing == ["c"] and d.extra == ["z"] and d.reordered


def test_split_sizes_and_stability(spark):
    rows = [(i, "s%d" % (i % 3 if i < 900 else 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, s string")
    a = split.split(df, "k", strata="s")
    sizes = {(r["s"], r["split"]): r["n"] for r in split.split_sizes(a, "s").collect()}
    for s in ("s0", "s1", "s2"):
        n = sum(1 for r in rows if r[1] == s)
        assert sizes[(s, "test")] == math.ceil(0.2 * n)
    b = split.split(df.repartition(7), "k", strata="s")
    assert sorted(r["k"] for r in a.filter("split = 'test'").collect()) == \
        sorted(r["k"] for r in b.filter("split = 'test'").collect())


def test_split_boundary_bucket(spark, monkeypatch):
    monkeypatch.setattr(split, "_HB_SHIFT", 62)   # four hash buckets: force a boundary bucket
    df = spark.createDataFrame([(i,) for i in range(333)], "k long")
    a = split.split(df, "k")
    assert a.filter("split = 'test'").count() == math.ceil(0.2 * 333)


AI4I_HEADER = ("UDI,Product ID,Type,Air temperature [K],Process temperature [K],Rotational speed [rpm],"
               "Torque [Nm],Tool wear [min],Machine failure,TWF,HDF,PWF,OSF,RNF")
AI4I_ROWS = [
    "1,M14860,M,298.1,308.6,1551,42.8,0,0,0,0,0,0,0",
    "2,L47181,L,298.2,308.7,1408,46.3,3,1,1,1,0,0,0",
    "3,L47182,L,298.1,308.5,1498,49.4,250,0,0,0,0,0,1",
    "800,L47183,L,298.2,308.6,1433,39.5,7,1,0,0,1,0,0",
]


def test_ai4i_normalise(spark, tmp_dir):
    p = os.path.join(tmp_dir, "ai4i.csv")
    with open(p, "w") as f:
        f.write("\n".join([AI4I_HEADER, *AI4I_ROWS]) + "\n")
    raw = files.read_ai4i(spark, p)
    s = {r["equipment_id"]: r for r in normalize.normalize_ai4i(raw).collect()}
    assert s["Machine_14860"]["timestamp"] == dt.datetime(2020, 1, 1, 1)
    assert s["Machine_14860"]["vibration"] == pytest.approx(2.981)
    assert s["Machine_14860"]["pressure"] == pytest.approx(155.1)
    assert s["LL47181".replace("LL", "Machine_L")]["failure_type"] == "Tool Wear Failure"
    assert s["Machine_L47182"]["failure_type"] == "Random Failure"
    assert s["Machine_L47182"]["failure_imminent"] is False
    assert s["Machine_L47182"]["degradation_level"] == 1.0
    m = normalize.ai4i_maintenance(raw).collect()
    assert sorted(r["equipment_id"] for r in m) == ["Machine_L47181", "Machine_L47183"]
    v1 = {r["equipment_id"]: r for r in normalize.normalize_ai4i_v1(raw).collect()}
    assert v1["Machine_L47183"]["timestamp"] is None         # day 34 does not exist
    assert v1["Machine_L47182"]["degradation_level"] == 1.0


def test_cmapss_reader(spark, tmp_dir):
    p = os.path.join(tmp_dir, "train.txt")
    lines = []
    for unit in (1, 2):
        for cyc in range(1, 11 if unit == 1 else 5):
            vals = [unit, cyc, 0.1, 0.2, 100.0] + [float(unit * 100 + cyc + i) for i in range(21)]
            lines.append(" ".join(str(v) for v in vals) + "  ")
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    raw = files.read_cmapss(spark, p)
    assert raw.count() == 14 and raw.columns[:3] == ["unit", "cycle", "op_setting_1"]
    n = {(r["equipment_id"], r["timestamp"].hour): r for r in normalize.normalize_cmapss(raw).collect()}
    assert n[("Engine_001", 10)]["degradation_level"] == 1.0
    assert n[("Engine_001", 10)]["failure_imminent"] and not n[("Engine_001", 9)]["failure_imminent"]
    assert n[("Engine_002", 4)]["rpm"] == 2.0 * 100 + 4 + 4
    rp = os.path.join(tmp_dir, "rul.txt")
    with open(rp, "w") as f:
        f.write("112\n98\n")
    assert [tuple(r) for r in files.read_cmapss_rul(spark, rp).orderBy("unit").collect()] == [(1, 112.0), (2, 98.0)]


def test_ranges_json_roundtrip_and_sinks(spark, tmp_dir):
    rng = spark.createDataFrame([(k, lo, hi, (lo + hi) / 2, 1.0) for k, (lo, hi) in RANGES.items()],
                                "sensor string, min double, max double, mean double, std double")
    p = os.path.join(tmp_dir, "ranges")
    files.write_ranges_json(rng, p)
    back = {r["sensor"]: (r["min"], r["max"]) for r in files.read_ranges_json(spark, p).collect()}
    assert back == RANGES
    empty = spark.createDataFrame([], "a int")
    assert files.write_table(empty, os.path.join(tmp_dir, "e"), skip_empty=True) is False
    assert files.write_table(rng, os.path.join(tmp_dir, "c"), fmt="csv") is True
    with pytest.raises(files.MissingSourceError):
        files.require_paths(spark, {"raw": os.path.join(tmp_dir, "nope.csv")})
    with pytest.raises(ValueError):
        files.load_dataset("no_such", spark)


def test_scoring_requests_reject(spark, tmp_dir):
    p = os.path.join(tmp_dir, "req.json")
    with open(p, "w") as f:
        f.write(json.dumps({"equipment_id": "a", "vibration": 3.0, "temperature": 310, "pressure": 150,
                            "current": 40, "rpm": 1500, "tool_wear": 100}) + "\n")
        f.write(json.dumps({"equipment_id": "b", "vibration": 3.0}) + "\n")
    with pytest.raises(ValueError):
        files.read_scoring_requests(spark, p)
    assert files.read_scoring_requests(spark, p, reject=False).count() == 2


def test_timestamp_parse_modes(spark):
    df = spark.createDataFrame([("2020-01-31 10:00:00",), ("2020-01-32 10:00:00",)], "timestamp string")
    coerced = files.parse_timestamps(df, strict=False).collect()
    assert coerced[1]["timestamp"] is None
    with pytest.raises(Exception):
        files.parse_timestamps(df, strict=True).collect()


def test_template_alignment(spark):
    feats = ["vibration_mean", "vibration_std", "temperature_max", "ambient_temperature_mean",
             "production_rate_mean", "tool_wear_range"]
    df = spark.createDataFrame([(3.0, 310.0, None)], "vibration double, temperature double, tool_wear double")
    r = ml.align_to_template(df, feats).first()
    assert list(r.asDict()) == feats
    assert (r["vibration_mean"], r["vibration_std"], r["temperature_max"]) == (3.0, 0.1, 310.0)
    assert r["ambient_temperature_mean"] == 310.0 and r["production_rate_mean"] == 0.0
    assert r["tool_wear_range"] == 0.1
    p = ml.align_to_template(df, feats, match="prefix").first()
    assert p["ambient_temperature_mean"] == 0.0
    b = ml.basic_vector(df).first()
    assert len(b) == 50 and b["feature_49"] == 0.0


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    p = ml.fit_scaler(df, ["a", "c"])
    assert p.mean["a"] == 2.0 and p.scale["a"] == 1.0 and p.scale["c"] == 1.0
    got = [r["a"] for r in ml.apply_scaler(df, p).collect()]
    assert got == [-1.0, 1.0]


def test_forest_train_save_load(spark, tmp_dir):
    rows = [(f"e{i}", float(i), float(i % 5), 1000.0 - 10 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "equipment_id string, x double, y double, rul double")
    tm = ml.train(df, ["x", "y"], "rul", ml.forest(n_trees=10, depth=5))
    m = ml.regression_metrics(ml.predict(tm, df)).first()
    assert m["r2"] > 0.8 and m["mae"] >= 0
    tm.save(os.path.join(tmp_dir, "m"))
    back = ml.TrainedModel.load(spark, os.path.join(tmp_dir, "m"))
    a = [r["prediction"] for r in ml.predict(tm, df).orderBy("equipment_id").collect()]
    b = [r["prediction"] for r in ml.predict(back, df).orderBy("equipment_id").collect()]
    assert a == b and back.feature_columns == ["x", "y"]
    res = ml.prediction_result(ml.predict(tm, df), as_of="2024-01-01 00:00:00").first()
    assert res["maintenance_recommendation"].split(":")[0] in ("CRITICAL", "HIGH", "MEDIUM")


def test_weighted_ensemble(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    v = df.select(ml.weighted_ensemble(["a", "b", "c", "d"]).alias("e")).first()["e"]
    assert v == pytest.approx((0.35 + 0.6 + 0.75 + 0.4) / 1.0)


def test_critical_readings(spark):
    rows = [(k, *[float(x) for x in v[:6]]) for k, v in READINGS.items()]
    df = spark.createDataFrame(rows, "equipment_id string, vibration double, temperature double, "
                                     "pressure double, current double, rpm double, tool_wear double")
    got = sorted((r["equipment_id"], r["sensor"]) for r in quality.critical_readings(df, ["equipment_id"]).collect())
    assert ("machine_2", "vibration") in got and ("machine_2", "temperature") in got
    assert ("out_of_range", "rpm") in got
    assert not any(k == "critical" for k, _ in got)      # 3.06 / 314 / ... are not above


def test_aggregate_scoring_and_retrain(spark, tmp_dir):
    from vigil.plans import jobs
    rows = [(f"e{i % 12}", float(i % 12), float(i % 5), float(i)) for i in range(240)]
    req = spark.createDataFrame(rows, "equipment_id string, vibration double, temperature double, noise double")
    feats = __import__("vigil.operators.features", fromlist=["x"]).equipment_features(req)
    labels = feats.select("equipment_id", (1000.0 - F.col("vibration_mean") * 50).alias("rul"))
    fp, lp = os.path.join(tmp_dir, "f"), os.path.join(tmp_dir, "l")
    feats.write.parquet(fp)
    labels.write.parquet(lp)
    res = jobs.retrain_job(spark, fp, lp, os.path.join(tmp_dir, "out"),
                           jobs.JobConfig(trees=10, depth=4))
    assert set(res.metrics) == {"mae", "rmse", "r2"}
    scored = ml.score_request_aggregate(res.model, req).collect()
    assert len(scored) == 12 and all(r["predicted_rul_hours"] >= 0 for r in scored)


def test_zero_pad_matches_python_format(spark):
    vals = [0, 5, 42, 999, 1000, 123456, -1, -9, -10, -99, -100, -12345]
    df = spark.createDataFrame([(v,) for v in vals], "n long")
    got = [r[0] for r in df.select(normalize.zero_pad(F.col("n"), 3)).collect()]
    assert got == ["%03d" % v for v in vals]


def test_warning_text_uses_python_float_layout(spark):
    df = spark.createDataFrame([("e", 2.5e7)], "equipment_id string, rpm double")
    w = quality.validate_ranges(df, {"rpm": (1000.0, 2076.6)}).first()["data_quality_warnings"]
    assert w == ["rpm=25000000.0 outside expected range [1000.00, 2076.60]"]
