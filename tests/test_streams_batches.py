"""Streams over many micro-batches: state that outlives a batch and a restart, rows out of order, late rows, pruned reads."""
import datetime as dt
import os

from pyspark.sql import functions as F

from vigil.operators import series
from vigil.operators.asof import asof_join
from vigil.plans import streams
from vigil.streaming import stateful, stored_asof

D = dt.datetime
SCHEMA = "equipment_id string, timestamp timestamp, event_id long, degradation_level double, failure_imminent boolean, temperature double"


def _rows(n=240):
    return [(None if i % 4 == 3 else "e%d" % (i % 4), D(2024, 1, 1) + dt.timedelta(hours=2 * i), i, (i % 30) / 30.0, None if i % 11 == 0 else i % 5 == 0, 310.0 + i % 7)
            for i in range(n)]


def _file(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _far(at=400):
    return [("~", D(2024, 1, 1) + dt.timedelta(days=at), 10_000, None, None, None)]


def _cooldown(spark, src, out, check):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    made = stateful.cooldown_reordered(stream, 0.5, 3 * 86400, watermark="2 days")
    q = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_cooldown_waits_for_rows_out_of_order_and_outlives_a_restart(spark, tmp_dir):
    rows, src, out, check = _rows(), os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "check")
    moved = [r for r in rows if r[2] % 9 == 4]  # come one file later, within the two days
    parts = [[r for r in rows if r not in moved and r[2] // 20 == k] + [r for r in moved if r[2] // 20 == k - 1] for k in range(13)]
    late = ("e0", D(2024, 1, 2, 1), 9_999, 1.0, True, 0.0)
    for part in parts[:6]:
        _file(spark, src, part)
    _cooldown(spark, src, out, check)  # stops with rows held back
    before = spark.read.parquet(out).count()
    for k, part in enumerate(parts[6:]):
        _file(spark, src, part + ([late] if k == 4 else []))
    _file(spark, src, _far())
    q = _cooldown(spark, src, out, check)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("event_id", "maintenance_type").collect())
    batch = spark.createDataFrame(rows, SCHEMA)
    exp = series.maintenance_from_cooldown(series.cooldown_events(batch, F.col("degradation_level") > 0.5, gap_seconds=3 * 86400).withColumn(
        "failure_imminent", F.coalesce("failure_imminent", F.lit(False))), ts="event_id")
    assert got == sorted((r.event_id, r.maintenance_type) for r in exp.collect()) and 0 < before < len(got)
    assert stateful.dropped_late(q) == 1


def test_alerts_late_rows_and_a_replayed_epoch(spark, tmp_dir):
    src, path, check = (os.path.join(tmp_dir, n) for n in ("in", "alerts", "check"))
    rows = _rows(120)
    for k in range(6):
        _file(spark, src, rows[20 * k:20 * k + 20])
    late = ("e0", D(2024, 1, 1, 5), 777, None, None, 316.0)
    _file(spark, src, [late])
    _file(spark, src, _far())
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    stateful.alert_fan_out(stream, path, check, {"temperature": 314.5, "absent": 1.0}, "1 day").awaitTermination()
    table = lambda kind: stateful.digests(spark, path, kind)
    hot = [r for r in rows if r[5] > 314.5]
    assert sorted(r.event_id for r in table("immediate").collect()) == sorted([r[2] for r in hot] + [777])
    assert {(r.kind, r.event_id) for r in table("late").collect()} == {("hourly", 777), ("daily", 777)}
    days = {}
    for e, t, *_ in hot:
        days[e, t.date()] = days.get((e, t.date()), 0) + 1
    assert {(r.equipment_id, r.window_start.date()): r.n for r in table("daily").collect()} == days
    assert sum(r.n for r in table("hourly").collect()) == len(hot)


def test_stored_as_of_reads_its_own_buckets(spark, tmp_dir):
    op = "equipment_id string, timestamp timestamp, seq long, rate double, value double"
    right = spark.createDataFrame(
        [("e%d" % (i % 3), D(2024, 1, 3) + dt.timedelta(hours=5 * i), i, None if i % 7 == 0 else float(i), 1.0) for i in range(200)]
        + [(None, D(2024, 1, 5), 500, 5.0, None), ("e0", D(2024, 1, 4), 501, 6.0, None), ("e0", D(2024, 1, 4), 502, 7.0, None), ("gone", D(2024, 1, 3), 503, 8.0, None), ("e1", None, 504, 9.0, None)], op)
    path = os.path.join(tmp_dir, "stored")
    stored_asof.store_operational(right, path, tiebreak=["seq"], bucket_seconds=86400, hashes=4)
    stored = stored_asof.StoredOperational(spark, path)
    left = spark.createDataFrame(
        [(e, D(2024, 1, 1) + dt.timedelta(hours=7 * i), i, float(i)) for i, e in enumerate(["e0", "e1", "e2", None, "gone", "new"] * 40)]
        + [("e0", None, 999, 0.0), ("e0", D(2024, 1, 4), 1000, 0.0), ("e1", D(2025, 1, 1), 1001, 0.0)],
        "equipment_id string, timestamp timestamp, event_id long, value double")
    want = asof_join(left, right.filter("timestamp IS NOT NULL"), left_tiebreak=["event_id"], right_tiebreak=["seq"])
    got = stored.enrich(left, left_tiebreak=["event_id"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    one = left.filter("event_id = 60")  # e0, 2024-01-18
    used = stored.slice_for(one, "timestamp", "equipment_id")
    read = used.select(F.input_file_name().alias("f")).distinct().count()
    assert 1 <= read <= 2 < len(spark.read.parquet(f"{path}/rows").inputFiles())
    plan = used._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "tb#" in plan
    assert stored.enrich(left.limit(0)).count() == 0


def test_stored_as_of_with_many_folders_joins_them(spark, tmp_dir, monkeypatch):
    op = "equipment_id string, timestamp timestamp, rate double"
    right = spark.createDataFrame([("e%d" % (i % 3), D(2024, 1, 3) + dt.timedelta(hours=5 * i), float(i)) for i in range(60)], op)
    left = spark.createDataFrame([("e%d" % (i % 3), D(2024, 1, 2) + dt.timedelta(hours=6 * i), i) for i in range(80)], "equipment_id string, timestamp timestamp, event_id long")
    path = os.path.join(tmp_dir, "stored")
    stored_asof.store_operational(right, path, bucket_seconds=7200, hashes=2)
    monkeypatch.setattr(stored_asof, "MOST_FOLDERS", 3)
    got = stored_asof.StoredOperational(spark, path).enrich(left, left_tiebreak=["event_id"])
    want = asof_join(left, right, left_tiebreak=["event_id"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    empty = os.path.join(tmp_dir, "empty")
    stored_asof.store_operational(right.limit(0), empty)
    assert stored_asof.StoredOperational(spark, empty).enrich(left).filter("rate IS NOT NULL").count() == 0


def test_cooldown_keeps_its_state_by_bucket(spark, tmp_dir):
    src, out, check = (os.path.join(tmp_dir, n) for n in ("in", "out", "check"))
    rows = [(None if i % 60 == 7 else "m%d" % (i % 60), D(2024, 1, 1) + dt.timedelta(hours=i // 60), None if i % 4 == 1 else i, (i * 7 % 30) / 30.0, i % 5 == 0, None)
            for i in range(60 * 40)]
    for k in range(4):
        _file(spark, src, rows[600 * k:600 * (k + 1)])
    _file(spark, src, _far())
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    made = stateful.cooldown_reordered(stream, 0.5, 6 * 3600, watermark="12 hours", buckets=3)
    q = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    # a fold, a list of held rows and a few timers for each bucket, not for each of the 60 machines
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) < 40
    got = [tuple(r) for r in spark.read.parquet(out).select("equipment_id", "timestamp", "event_id", "maintenance_type").collect()]
    want, last = [], {}
    for e, t, i, level, failing, _ in rows:  # in time order, one row an hour and machine
        since = last.setdefault(e, t)
        if level > 0.5 and t > since + dt.timedelta(hours=6):
            last[e] = t
            want.append((e, t, i, "corrective" if failing else "preventive"))
    assert sorted(got, key=str) == sorted(want, key=str) and any(i is None for _, _, i, _ in want) and any(e is None for e, _, _, _ in want)


def test_a_micro_batch_is_a_chunk_whatever_its_rows(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 20)
    times = [0, 10_000] + [7_050 + i for i in range(900)]  # seconds: most chunks are empty, one has nearly all rows
    df = spark.createDataFrame([(i, D(2024, 1, 1) + dt.timedelta(seconds=s), "e") for i, s in enumerate(times)], "event_id long, timestamp timestamp, equipment_id string")
    stream, _ = streams.feed(spark, df, "feed-test", late=False)
    sizes = []
    q = stream.writeStream.foreachBatch(lambda batch, k: sizes.append(batch.filter(F.col("equipment_id") == "e").count())).trigger(availableNow=True).start()
    q.awaitTermination()
    shifted = sum(i % 7 == 0 for i in range(2, 902))
    assert sizes == [0, 1, 0, 0, 0, 0, 0, 900 - shifted, shifted, 1, 0]
