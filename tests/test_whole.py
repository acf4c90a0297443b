"""Request files, stored models, manifests, burst-safe windows and salted joins."""
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from vigil.operators import features, ml, model_store, normalize, quality, series
from vigil.operators.ordered import join_salted
from vigil.plans import jobs, manifest
from vigil.sources import requests
from vigil.streaming import jobs as streaming

D = dt.datetime
ONE = {"vibration": 3.0, "temperature": 310, "pressure": 150.5, "current": "40", "rpm": 1500, "tool_wear": 12}


def test_every_line_is_a_request_or_a_reject(spark, tmp_dir):
    def with_(**kw):
        return {k: v for k, v in {**ONE, **kw}.items() if v is not ...}
    lines = [
        json.dumps(ONE), json.dumps(with_(equipment_id="a", note="extra")), json.dumps([with_(equipment_id="b"), with_(equipment_id="c", rpm=None), with_()]),
        json.dumps(with_(vibration="fast")), json.dumps(with_(rpm=...)), json.dumps(with_(rpm=True, current={"x": 1})), '{"vibration": 3', "[", "nonsense", '"text"', "17", "null", "[]", "[1, null]",
        "", "   ", json.dumps(with_(temperature=float("nan"))), json.dumps(with_(equipment_id=12)), json.dumps([[with_()]]),
    ]
    path = os.path.join(tmp_dir, "requests")
    os.makedirs(path)
    with open(f"{path}/a.json", "w") as f:
        f.write("\n".join(lines) + "\n")
    good, bad = requests.read_requests(spark, path)
    assert sorted((r.form, r.equipment_id, r.current) for r in good.collect() if r.equipment_id) == [("batch", "b", 40.0), ("single", "12", 40.0), ("single", "a", 40.0)]
    assert good.count() == 4 and {r.file for r in good.collect()} == {"a.json"}
    got = sorted((r.reason, r.form, r.fields) for r in bad.collect())
    assert [g for g in got if g[0] != "malformed"] == [
        ("incomplete", "batch", "equipment_id"), ("incomplete", "batch", "rpm"), ("incomplete", "single", "rpm"),
        ("wrong type", "single", "current,rpm"), ("wrong type", "single", "temperature"), ("wrong type", "single", "vibration")]
    assert sum(g[0] == "malformed" for g in got) == 9  # 3 broken lines, 3 that are no object, 2 elements, 1 nested array
    assert all(r.element for r in bad.filter("reason <> 'malformed'").collect())


@pytest.fixture(scope="module")
def trained(spark):
    rows = [("e%d" % i, float(i % 7), float(i % 5) * 2, float((i * 3) % 11), 100.0 + 3 * (i % 7) - (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "equipment_id string, a double, b double, c double, rul double")
    return df, ml.train(df, ["a", "b", "c"], "rul", ml.forest(5, 3))


def test_versions_are_complete_or_absent(spark, tmp_dir, trained):
    df, model = trained
    store = model_store.ModelStore(spark, os.path.join(tmp_dir, "store"))
    assert store.versions() == []
    with pytest.raises(FileNotFoundError):
        store.load()
    assert store.save(model) == 1
    model.save(f"{store.path}/v=2/model")  # a job that was lost before its last file
    assert store.versions() == [1] and store.save(model) == 3 and store.versions() == [1, 3]
    with pytest.raises(FileNotFoundError):
        store.load(2)
    want = {r.equipment_id: r.prediction for r in ml.predict(model, df).collect()}
    assert {r.equipment_id: r.prediction for r in ml.predict(store.load(1), df).collect()} == want
    drift = {r["column"]: r.state for r in store.drift(df.select("b", "a", F.col("c").cast("string").alias("c"), "rul", "equipment_id")).collect()}
    assert drift == {"a": "moved", "b": "moved", "c": "not a number", "rul": "extra"}
    assert {r.state for r in store.drift(df.select("a", "b", "c")).collect()} == {"ok"}


def test_nodes_of_a_forest_give_its_predictions(spark, trained):
    df, model = trained
    more = df.unionByName(spark.createDataFrame([("x", None, 1e9, -1e9, 0.0)], df.schema))
    nodes = model_store.forest_nodes(model)
    walked = {r.equipment_id: r.walked for r in model_store.walk_forest(model, nodes, more, "equipment_id").collect()}
    want = {r.equipment_id: r.prediction for r in ml.predict(model, more).collect()}
    assert walked.keys() == want.keys() and all(abs(walked[k] - want[k]) < 1e-9 for k in want)
    assert nodes.filter("feature >= 0 AND (left IS NULL OR right IS NULL)").count() == 0


def test_a_manifest_reruns_what_changed(spark, tmp_dir):
    src, out, ran = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "out"), []
    spark.range(3).write.parquet(src)

    def run(setting):
        m = manifest.Manifest(spark, out)

        def first():
            spark.range(4).write.mode("overwrite").parquet(f"{out}/t")
            return {"outputs": {"t": f"{out}/t", "none": None}, "n": 4}
        assert m.step("first", manifest.files_fingerprint(spark, {"src": src}), first)["n"] == 4
        m.step("second", setting, lambda: {"outputs": {}}, after=("first",))
        m.step("third", 0, lambda: {"outputs": {}}, after=("second",))
        ran.append((m.ran, m.skipped))
    run(1)
    run(1)
    run(2)
    spark.range(5).write.mode("append").parquet(src)
    run(2)
    assert [r for r, _ in ran] == [["first", "second", "third"], [], ["second", "third"], ["first", "second", "third"]]
    assert ran[1][1] == ["first", "second", "third"]


def test_a_burst_is_split_over_sub_buckets_and_changes_nothing(spark):
    rows = [("hot", D(2024, 1, 1, 6) + dt.timedelta(milliseconds=37 * k), k, float(k % 91)) for k in range(1500)]
    rows += [("hot", D(2024, 1, 1) + dt.timedelta(hours=k), 5000 + k, 1.0) for k in range(30)] + [("cool", D(2024, 1, 1) + dt.timedelta(hours=k), 6000 + k, 2.0) for k in range(30)]
    rows += [("cool", None, 7000, 3.0), ("cool", D(1969, 12, 31, 23), 7001, 4.0)]
    df = spark.createDataFrame(rows, "equipment_id string, timestamp timestamp, event_id long, v double")
    stats = ("mean", "max", "min", "count", "sum")
    wide = series.rolling_features(df, ["v"], 3600, stats=stats)
    narrow = series.rolling_features(df, ["v"], 3600, stats=stats, target_rows=100)
    width = series.rolling_width(df, 3600, "equipment_id", "timestamp", 24, 100)
    slot = F.floor(F.unix_micros("timestamp") / width)
    assert df.groupBy("equipment_id", slot).count().agg(F.max("count")).first()[0] > 0
    assert df.filter("timestamp IS NOT NULL").groupBy("equipment_id", slot).count().agg(F.max("count")).first()[0] <= 100
    assert width < 3600 * 1_000_000 // 24 and 3600 * 1_000_000 % width == 0
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(key, wide.collect()), key=str) == sorted(map(key, narrow.collect()), key=str)
    got = {r.event_id: r for r in narrow.collect()}
    for e, t, n, _ in rows[::97]:
        win = [v for e2, t2, _, v in rows if e2 == e and t2 is not None and t - dt.timedelta(hours=1) < t2 <= t]
        assert got[n].v_roll_count == len(win) and got[n].v_roll_max == max(win) and got[n].v_roll_min == min(win)


def test_no_join_on_the_unit_alone(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(1)).otherwise((F.col("id") % 9).cast("int")).alias("unit"), (F.col("id") % 500).alias("cycle"))
    with_null = rows.unionByName(spark.sql("select cast(null as int) as unit, 7L as cycle"))
    got = features.group_max_over(with_null, "unit", "cycle", "most")
    want = {r.unit: r.m for r in with_null.groupBy("unit").agg(F.max("cycle").alias("m")).collect()}
    assert all(want[r.unit] == r.most for r in got.collect()) and got.count() == 3001
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (features.group_max_over(with_null, "unit", "cycle", "most"), normalize.normalize_cmapss(rows.withColumn("sensor_1", F.lit(1.0)))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            joined = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
            assert joined and all("_salt" in line for line in joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert join_salted(rows, rows.groupBy("unit").agg(F.max("cycle").alias("m")), ["unit"], salts=7).count() == 3000


def test_correlation_of_columns_with_nulls_and_constants(spark):
    rows = [(float(k), None if k % 3 else 2.0 * k + k % 2, 5.0, None if k < 9 else 1.0) for k in range(12)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r.sensor_a, r.sensor_b): r["corr"] for r in series.corr_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 16 and got["a", "a"] == pytest.approx(1.0) and got["a", "b"] == got["b", "a"] > 0.99
    assert all(v is None for k, v in got.items() if "c" in k or "d" in k)
    empty = series.corr_matrix(df.limit(0), ["a", "b"]).collect()
    assert len(empty) == 4 and all(r["corr"] is None for r in empty)


def test_warnings_of_a_row_are_null_or_a_list(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 1.0, 1e-5), (3, None, None)], "id long, a double, b double")
    got = {r.id: r.w for r in quality.validate_ranges(df, {"a": (0.0, 2.0), "b": (1.0, 2.0), "absent": (0.0, 1.0)}, "w").collect()}
    assert got == {1: ["a=5.0 outside expected range [0.00, 2.00]"], 2: ["b=1e-05 outside expected range [1.00, 2.00]"], 3: None}


def test_latest_row_is_one_row(spark):
    t = D(2024, 1, 1)
    df = spark.createDataFrame([("e", t, 1, 9), ("e", t, 2, 3), ("e", D(2023, 1, 1), 8, 8), ("f", t, None, 1)], "equipment_id string, timestamp timestamp, a long, b long")
    assert {(r.equipment_id, r.a, r.b) for r in streaming.latest_predictions(df, columns=["a", "b"]).collect()} == {("e", 2, 3), ("f", None, 1)}


def test_commands_run_whole_jobs(spark, tmp_dir, capsys, monkeypatch):
    rows = [("e%d" % (i % 4), D(2024, 1, 1) + dt.timedelta(hours=i), 3.0 + i % 5 / 100, 305.0 + i % 9, 150.0, 40.0, 1500.0, float(i % 200), (i % 30) / 30.0, i % 5 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "equipment_id string, timestamp timestamp, vibration double, temperature double, pressure double, current double, rpm double, tool_wear double, "
                                     "degradation_level double, failure_imminent boolean")
    src = os.path.join(tmp_dir, "sensor")
    df.write.parquet(src)
    monkeypatch.setattr(ml, "FOREST_TREES", 3)
    for cmd in (["features", "--sensor", src], ["fleet", "--readings", src], ["profile", "--sensor", src]):
        jobs.main([*cmd, "--out", os.path.join(tmp_dir, cmd[0])])
    assert spark.read.parquet(os.path.join(tmp_dir, "features", "labels")).count() == 4
    jobs.main(["retrain", "--features", os.path.join(tmp_dir, "features", "features"), "--labels", os.path.join(tmp_dir, "features", "labels"), "--out", os.path.join(tmp_dir, "re")])
    assert "mae" in capsys.readouterr().out
    assert spark.read.parquet(os.path.join(tmp_dir, "profile", "profile")).first()["record_count"] == 200
    with pytest.raises(SystemExit):
        jobs.main(["dataset", "--name", "unknown", "--out", "x"])


def test_lines_are_parsed_once_for_both_tables(spark, tmp_dir):
    path = os.path.join(tmp_dir, "requests-once")
    os.makedirs(path)
    with open(f"{path}/a.json", "w") as f:
        f.write("\n".join([json.dumps(ONE), json.dumps([{**ONE, "equipment_id": "b"}, 1]), "[ 1,", "[]"]) + "\n")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    parsed = plan(requests.parse_requests(spark.read.text(path)))
    assert parsed.count("from_json(") == 2 and parsed.count("Relation") == 1  # lines and elements, in one read
    good, bad = requests.read_requests(spark, path)
    assert "from_json(" not in plan(good) + plan(bad)
    assert good.count() == 2 and sorted((r.form, r.at, r.element) for r in bad.collect()) == [("batch", 0, "[ 1,"), ("batch", 1, "1")]
