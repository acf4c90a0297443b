"""Plan-shape guards: the scale properties the README promises stay true."""
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from vigil.operators import clean, features, series
from vigil.operators.asof import asof_join

D = dt.datetime
FORBIDDEN = ("SortAggregate", "CartesianProduct", "BroadcastNestedLoopJoin")
QUADRATIC = re.compile(r"specifiedwindowframe\((?:rowframe|rangeframe), (?!unboundedpreceding)[^,()]*(?:\(\))?, "
                       r"unboundedfollowing")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def readings(spark):
    rows = [("e%d" % (i % 3), D(2024, 1, 1) + dt.timedelta(hours=i), i, None if i % 5 == 0 else float(i),
             (i % 10) / 10.0) for i in range(60)]
    return spark.createDataFrame(rows, "equipment_id string, timestamp timestamp, event_id long, v double, d double")


def test_ordered_operators_have_linear_frames(spark, readings):
    right = readings.select("equipment_id", "timestamp", F.col("event_id").alias("rid"), F.col("v").alias("rv"))
    plans = {
        "asof": _plan(asof_join(readings, right, on="timestamp", by="equipment_id", left_tiebreak="event_id",
                                right_tiebreak="rid")),
        "interpolate": _plan(clean.interpolate_linear(readings, ["v"], tiebreak=["event_id"])),
        "positions": _plan(features.with_positions(readings, tiebreak=["event_id"], count="n")),
        "rolling": _plan(series.rolling_features(readings, ["v"], 6 * 3600, tiebreak="event_id",
                                                 stats=("mean", "max", "count"))),
        "labels": _plan(features.equipment_labels(readings, order=["timestamp", "event_id"], degradation="d")),
    }
    for name, plan in plans.items():
        for bad in FORBIDDEN:
            assert bad not in plan, (name, bad)
        # frames from a row to "unbounded following" are re-aggregated per row (quadratic);
        # whole-partition frames (unbounded preceding .. unbounded following) are computed once
        assert not QUADRATIC.search(plan.lower()), name


def test_cooldown_has_no_forbidden_nodes(spark, readings):
    em = series.cooldown_events(readings, F.col("d") > 0.5, gap_seconds=5 * 3600)
    plan = _plan(em)
    for bad in FORBIDDEN:
        assert bad not in plan
