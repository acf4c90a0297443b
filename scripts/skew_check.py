"""Skew experiment: one equipment holding a third of all rows.

Builds ~1M readings from the sf0.1 events table (ten time-shifted copies; every
third row re-assigned to one hot equipment) and compares, for row positions and
for the as-of join, the naive per-equipment window with the bucketed ordered
scan: rows in the largest window partition and wall time.  Not a registered
query; a scale check for the README.

Usage: python scripts/skew_check.py [sf_dir] [copies]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from vigil.operators.asof import asof_join
    from vigil.operators.ordered import BUCKET, positions, time_bucket
    from vigil.session import build_session
    from vigil.sources.tables import read_table

    spark = build_session("local[8]", app="vigil-skew", shuffle_partitions=32)
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    span = ev.agg(F.max("event_id")).first()[0] + 1
    data = (ev.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            .select((F.col("event_id") + F.col("c") * span).alias("event_id"),
                    (F.col("ts") + F.expr("make_interval(0, 0, 0, 31) ") * F.col("c")).alias("ts"),
                    F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("eq"),
                    "event_type", "value"))
    data = data.persist()
    n = data.count()
    hot = data.filter(F.col("eq") == -1).count()
    print(f"rows {n}, hot equipment rows {hot} ({hot / n:.0%})")

    def timed(label, df):
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    # positions: naive window vs ordered scan
    naive = data.withColumn("pos", F.row_number().over(Window.partitionBy("eq").orderBy("ts", "event_id")) - 1)
    ours = positions(data, "eq", [F.col("ts"), F.col("event_id")], time_bucket(F.col("ts")), out="pos")
    naive_max = data.groupBy("eq").count().agg(F.max("count")).first()[0]
    ours_max = data.groupBy("eq", time_bucket(F.col("ts")).alias(BUCKET)).count().agg(F.max("count")).first()[0]
    timed("warm", ours)
    t_naive, t_ours = timed("naive", naive), timed("ours", ours)
    same = naive.select("event_id", "pos").exceptAll(ours.select("event_id", "pos")).isEmpty()
    print(f"positions: largest window partition naive {naive_max} rows, bucketed {ours_max} rows; "
          f"time naive {t_naive:.2f}s, bucketed {t_ours:.2f}s; identical: {same}")

    # as-of join purchases <- views: naive single-partition-per-key window vs ours
    left = data.filter(F.col("event_type") == "purchase").select("event_id", "ts", "eq", "value")
    right = data.filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("rid"), "ts", "eq", F.col("value").alias("rv"))
    un = (left.select("eq", "ts", F.lit(1).alias("s"), "event_id", F.lit(None).cast("double").alias("rv"))
          .unionByName(right.select("eq", "ts", F.lit(0).alias("s"), F.col("rid").alias("event_id"), "rv")))
    w = Window.partitionBy("eq").orderBy("ts", "s", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    naive_asof = un.withColumn("m", F.last("rv", ignorenulls=True).over(w)).filter("s = 1")
    ours_asof = asof_join(left, right, on="ts", by="eq", left_tiebreak="event_id", right_tiebreak="rid")
    timed("warm", ours_asof)
    print(f"as-of: time naive {timed('naive', naive_asof):.2f}s, bucketed {timed('ours', ours_asof):.2f}s")
    spark.stop()


if __name__ == "__main__":
    main()
