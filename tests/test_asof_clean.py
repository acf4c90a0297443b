"""As-of join, interpolation, z-score filter, median (FIXTURES §4 + brute force)."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import clean
from vigil.operators.asof import AsOfKeyError, asof_join

D = dt.datetime


def _asof(spark, left, right, **kw):
    l = spark.createDataFrame(left, "id string, timestamp timestamp, lid long")
    r = spark.createDataFrame(right, "id string, timestamp timestamp, rid long, p double")
    out = asof_join(l, r, on="timestamp", by="id", left_tiebreak="lid", right_tiebreak="rid", **kw)
    return {row["lid"]: row["p"] for row in out.collect()}


def test_asof_tie_takes_last(spark):
    got = _asof(spark, [("a", D(2024, 1, 2), 1)],
                [("a", D(2024, 1, 2), 1, 10.0), ("a", D(2024, 1, 2), 2, 11.0)])
    assert got == {1: 11.0}


def test_asof_none_and_null_attribute(spark):
    got = _asof(spark, [("b", D(2024, 1, 3), 1), ("a", D(2024, 1, 3), 2), ("a", None, 3)],
                [("b", D(2024, 1, 5), 1, 1.0), ("a", D(2024, 1, 1), 2, 5.0), ("a", D(2024, 1, 2), 3, None)])
    assert got == {1: None, 2: None, 3: None}


def test_asof_missing_key(spark):
    l = spark.createDataFrame([("a", D(2024, 1, 1))], "id string, timestamp timestamp")
    r = spark.createDataFrame([(D(2024, 1, 1), 1.0)], "timestamp timestamp, p double")
    with pytest.raises(AsOfKeyError):
        asof_join(l, r, on="timestamp", by="id")
    assert asof_join(l, r, on="timestamp", by="id", on_error="left").columns == ["id", "timestamp"]


def test_asof_matches_brute_force_across_buckets(spark):
    rnd = random.Random(7)
    base = D(2024, 1, 1)
    left, right = [], []
    for i in range(300):
        left.append((rnd.choice("abc"), base + dt.timedelta(hours=rnd.randint(0, 24 * 20)), i))
    for j in range(120):
        right.append((rnd.choice("abc"), base + dt.timedelta(hours=rnd.randint(0, 24 * 20)), j, float(j)))
    got = _asof(spark, left, right, bucket_seconds=3 * 86400)
    for (k, t, i) in left:
        cands = [r for r in right if r[0] == k and r[1] <= t]
        exp = max(cands, key=lambda r: (r[1], r[2]))[3] if cands else None
        assert got[i] == exp


def test_interpolate_fixture(spark):
    vals = [None, 1.0, None, None, 4.0, None]
    df = spark.createDataFrame([("e", D(2024, 1, 1, i), i, v) for i, v in enumerate(vals)],
                               "equipment_id string, timestamp timestamp, n long, v double")
    out = clean.interpolate_linear(df, ["v"], tiebreak=["n"], bucket_seconds=2 * 3600)
    got = [r["v"] for r in out.orderBy("n").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_interpolate_table_wide_matches_pandas(spark):
    import pandas as pd
    rnd = random.Random(3)
    vals = [None if rnd.random() < 0.3 else rnd.random() * 10 for _ in range(200)]
    rows = [(rnd.choice("xyz"), D(2024, 1, 1) + dt.timedelta(minutes=17 * i), i, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "equipment_id string, timestamp timestamp, n long, v double")
    out = clean.interpolate_linear(df, ["v"], by=None, tiebreak=["n"], bucket_seconds=3600)
    got = [r["v"] for r in out.orderBy("n").collect()]
    exp = pd.Series(vals, dtype="float64").interpolate(method="linear").bfill().tolist()
    assert np.allclose(got, exp, equal_nan=True)


def _rows(vals):
    return [(i, v) for i, v in enumerate(vals)]


def test_outlier_few_values_skipped(spark):
    df = spark.createDataFrame(_rows([1.0] * 9 + [1e9]), "i long, x double")
    assert clean.remove_outliers(df, ["x"]).count() == 10


def test_outlier_null_row_dropped(spark):
    df = spark.createDataFrame(_rows([float(v) for v in range(20)] + [None]), "i long, x double")
    assert clean.remove_outliers(df, ["x"]).count() == 20


def test_outlier_constant_kept(spark):
    df = spark.createDataFrame(_rows([0.1] * 15), "i long, x double")
    assert clean.remove_outliers(df, ["x"]).count() == 15


def test_outlier_sequential_matches_loop(spark):
    rnd = np.random.default_rng(1)
    a = rnd.normal(0, 1, 400)
    b = rnd.normal(0, 1, 400)
    a[:6] = 9.0
    b[:6] = 50.0      # outliers in b only counted if their rows survive a
    b[10:14] = 6.0
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "i long, a double, b double")
    got = sorted(r["i"] for r in clean.remove_outliers(df, ["a", "b"]).collect())
    keep = np.arange(400)
    for col in (a, b):
        v = col[keep]
        z = np.abs((v - v.mean()) / v.std())
        keep = keep[z < 3]
    assert got == keep.tolist()


def test_exact_median_narrowing(spark, monkeypatch):
    monkeypatch.setattr(clean, "MEDIAN_BINS", 8)
    rnd = np.random.default_rng(5)
    for n in (1, 2, 101, 1000):
        vals = np.concatenate([rnd.exponential(3, n), [7.0] * (n // 3)])
        df = spark.createDataFrame([(float(v),) for v in vals], "x double")
        assert clean.exact_median(df, "x") == pytest.approx(float(np.median(vals)), abs=1e-12)


def test_null_counts(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    r = clean.null_counts(df).first()
    assert (r["a"], r["b"], r["total_missing"]) == (1, 2, 3)


def test_ingest_nan_becomes_null(spark, tmp_dir):
    import os
    from vigil.sources.tables import read_table
    spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id long, x double") \
        .write.parquet(os.path.join(tmp_dir, "t.parquet"))
    got = {r["id"]: r["x"] for r in read_table(spark, tmp_dir, "t").collect()}
    assert got == {1: None, 2: 3.0}


def test_asof_null_keys_match_each_other(spark):
    l = spark.createDataFrame([(None, D(2024, 1, 2), 1)], "id string, timestamp timestamp, lid long")
    r = spark.createDataFrame([(None, D(2024, 1, 1), 1, 7.0)], "id string, timestamp timestamp, rid long, p double")
    out = asof_join(l, r, on="timestamp", by="id", left_tiebreak="lid", right_tiebreak="rid").collect()
    assert [x["p"] for x in out] == [7.0]


def test_fill_scan_matches_brute_force(spark):
    from vigil.operators.ordered import ordered_scan, time_bucket
    rnd = random.Random(17)
    rows = []
    for i in range(400):
        k = rnd.choice(["a", "b", None])
        t = D(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 30))
        v = float(i) if rnd.random() < 0.1 else None
        rows.append((k, t, i, v))
    df = spark.createDataFrame(rows, "k string, t timestamp, i long, v double")
    out = ordered_scan(df, "k", [F.col("t"), F.col("i")], time_bucket(F.col("t"), 6 * 3600),
                       forward={"f": F.col("v")}, backward={"b": F.col("v")}, position="pos",
                       group_count="n").collect()
    got = {r["i"]: (r["f"], r["b"], r["pos"], r["n"]) for r in out}
    for key in ("a", "b", None):
        sub = sorted([r for r in rows if r[0] == key], key=lambda r: (r[1], r[2]))
        for p, r in enumerate(sub):
            prev = [x[3] for x in sub[:p + 1] if x[3] is not None]
            nxt = [x[3] for x in sub[p:] if x[3] is not None]
            assert got[r[2]] == (prev[-1] if prev else None, nxt[0] if nxt else None, p, len(sub))


def test_exact_median_with_infinities(spark, monkeypatch):
    for vals in ([float("-inf"), 1.0, 2.0, 3.0, float("inf"), 5.0, 6.0],
                 [float("inf")] * 5 + [1.0, 2.0],
                 [float("-inf")] * 4 + [1.0]):
        df = spark.createDataFrame([(v,) for v in vals], "x double")
        assert clean.exact_median(df, "x") == float(np.median(vals))


def test_suggest_bucket_seconds(spark):
    from vigil.operators.ordered import suggest_bucket_seconds
    # hot key: 600 rows over 600 minutes (1 row / 60 s); cold key: 10 rows over 10 days
    rows = [("hot", D(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(600)]
    rows += [("cold", D(2024, 1, 1) + dt.timedelta(days=i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, t timestamp")
    assert suggest_bucket_seconds(df, "k", "t", target_rows=100) == 3600     # 60 rows of the hot key in an hour
    assert suggest_bucket_seconds(df, "k", "t", target_rows=10 ** 9) >= 365 * 86400
    # a burst of 500 rows in ten seconds in a long quiet history
    burst = df.unionByName(spark.range(500).select(F.lit("cold").alias("k"), F.timestamp_micros(F.lit(1704800000000000) + F.col("id") * 20000).alias("t")))
    for target in (60, 100, 300, 1000):
        w = suggest_bucket_seconds(burst, "k", "t", target_rows=target)
        most = burst.groupBy("k", F.floor(F.unix_micros("t") / F.lit(w * 1_000_000))).count().agg(F.max("count")).first()[0]
        assert most <= target, (target, w, most)
