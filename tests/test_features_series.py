"""Features, labels, trend, cooldown, rolling windows, correlation (FIXTURES §4)."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import features, series

D = dt.datetime


def test_std_single_and_allnull(spark):
    df = spark.createDataFrame([("a", 5.0, None), ("b", 1.0, None), ("b", 3.0, None)],
                               "equipment_id string, x double, y double")
    out = {r["equipment_id"]: r for r in features.equipment_features(df).collect()}
    assert out["a"]["x_std"] is None and out["a"]["x_mean"] == out["a"]["x_max"] == out["a"]["x_min"] == 5.0
    assert (out["a"]["y_mean"], out["a"]["y_std"], out["a"]["y_max"], out["a"]["y_min"]) == (0.0,) * 4
    assert out["b"]["x_std"] == pytest.approx(np.std([1.0, 3.0], ddof=1))


def test_labels(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1), 0.2), ("a", D(2024, 1, 2), None),
                                ("b", D(2024, 1, 1), 1.0), ("c", D(2024, 1, 1), 0.0)],
                               "equipment_id string, timestamp timestamp, degradation_level double")
    out = {r["equipment_id"]: (r["rul"], r["failure_probability"]) for r in features.equipment_labels(df).collect()}
    assert out == {"a": (0.0, 0.0), "b": (0.0, 0.0), "c": (1000.0, 0.95)}


def test_labels_without_degradation(spark):
    df = spark.createDataFrame([("a",), ("b",)], "equipment_id string")
    out = {r["equipment_id"]: r["rul"] for r in features.equipment_labels(df).collect()}
    assert out == {"a": 500.0, "b": 500.0}


def test_trend(spark):
    rows = [("a", D(2024, 1, 1, i), 3 + 0.5 * i, 1.0, 1.0, 1.0) for i in range(10)]
    rows += [("b", D(2024, 1, 1), 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "equipment_id string, timestamp timestamp, temperature double, "
                                     "vibration double, pressure double, current double")
    out = {r["equipment_id"]: r for r in features.simple_features(df, bucket_seconds=7200).collect()}
    assert out["a"]["temperature_trend"] == pytest.approx(0.5)
    assert out["b"]["temperature_trend"] is None
    assert out["a"]["rul"] == 900.0


def test_positions_across_buckets(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice("ab"), D(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 5000)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "equipment_id string, timestamp timestamp, n long")
    out = features.with_positions(df, tiebreak=["n"], bucket_seconds=3600).collect()
    got = {r["n"]: r["position"] for r in out}
    for k in "ab":
        sub = sorted([r for r in rows if r[0] == k], key=lambda r: (r[1], r[2]))
        for i, r in enumerate(sub):
            assert got[r[2]] == i


def _cooldown_loop(rows, threshold, gap):
    out = []
    for k in sorted({r[0] for r in rows}):
        sub = sorted([r for r in rows if r[0] == k], key=lambda r: (r[1], r[2]))
        last = sub[0][1]
        for eq, t, n, d in sub:
            if d is not None and d > threshold and (t - last).total_seconds() > gap:
                out.append(n)
                last = t
    return sorted(out)


def test_cooldown_fixture(spark):
    days = [0, 20, 31, 40, 62, 80]
    rows = [("e", D(2024, 1, 1) + dt.timedelta(days=d), i, 0.9) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "equipment_id string, timestamp timestamp, event_id long, d double")
    em = series.cooldown_events(df, F.col("d") > 0.8, gap_seconds=30 * 86400)
    got = sorted(r["event_id"] for r in em.collect())
    assert [days[i] for i in got] == [31, 62]


def test_cooldown_matches_loop(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("abc"), D(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 24 * 40)), i,
             rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "equipment_id string, timestamp timestamp, event_id long, d double")
    em = series.cooldown_events(df, F.col("d") > 0.6, gap_seconds=2 * 86400)
    assert sorted(r["event_id"] for r in em.collect()) == _cooldown_loop(rows, 0.6, 2 * 86400)


def test_rolling_matches_brute_force(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), D(2024, 1, 1) + dt.timedelta(minutes=30 * rnd.randint(0, 300)), i,
             None if rnd.random() < 0.15 else float(rnd.randint(0, 100))) for i in range(250)]
    df = spark.createDataFrame(rows, "equipment_id string, timestamp timestamp, n long, v double")
    w = 6 * 3600
    for m in (1, 3, 6, 24):
        out = series.rolling_features(df, ["v"], w, tiebreak="n", sub_buckets=m,
                                      stats=("mean", "max", "min", "count", "sum"))
        assert set(out.columns) >= set(df.columns)
        got = {r["n"]: r for r in out.collect()}
        for k, t, n, v in rows:
            win = [r[3] for r in rows if r[0] == k and t - dt.timedelta(seconds=w) < r[1] <= t
                   and r[3] is not None]
            g = got[n]
            assert g["v_roll_count"] == len(win), (m, n)
            assert g["v_roll_max"] == (max(win) if win else None)
            assert g["v_roll_min"] == (min(win) if win else None)
            if win:
                assert g["v_roll_mean"] == pytest.approx(sum(win) / len(win))
                assert g["v_roll_sum"] == pytest.approx(sum(win))
            else:
                assert g["v_roll_mean"] is None


def test_corr_constant_is_null(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(2 * i)) for i in range(10)], "a double, c double, b double")
    out = {(r["sensor_a"], r["sensor_b"]): r["corr"] for r in series.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert out[("a", "b")] == pytest.approx(1.0)
    assert out[("a", "c")] is None and out[("c", "c")] is None


def test_daily_spine(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1, 5)), ("a", D(2024, 1, 3, 4))],
                               "equipment_id string, timestamp timestamp")
    got = [r["timestamp"] for r in series.daily_spine(df).orderBy("timestamp").collect()]
    assert got == [D(2024, 1, 1, 5), D(2024, 1, 2, 5)]


def test_packed_order_sorts_like_struct(spark):
    from vigil.operators.ordered import packed_order
    rnd = random.Random(2)
    big = 2 ** 62
    rows = [(D(1960, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 10 ** 9), microseconds=rnd.randint(0, 999999)),
             rnd.choice([-big, -1, 0, 1, big, rnd.randint(-10 ** 12, 10 ** 12)])) for _ in range(300)]
    rows += [(rows[0][0], -5), (rows[0][0], 7)]
    df = spark.createDataFrame(rows, "t timestamp, tb long")
    got = [(r["t"], r["tb"]) for r in df.orderBy(packed_order(F.col("t"), F.col("tb"))).collect()]
    assert got == sorted(rows)
