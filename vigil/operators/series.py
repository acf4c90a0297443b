"""Time-series operators.

* ``cooldown_events`` (W07) is an order-dependent fold: emit a row when the
  trigger holds and more than ``gap`` has passed since the last emission.  It
  is computed without gathering a group: each candidate gets its successor
  (first candidate more than ``gap`` later — a forward as-of lookup through the
  skew-safe scan), then the chain from each series start is expanded by
  pointer doubling: log2(chain length) rounds of equi-joins on unique ids,
  with lineage cut by ``checkpoint()`` in the shared checkpoint folder.
* ``rolling_features`` (W09) computes right-closed time windows ``(t-w, t]`` from
  aggregates of sub-buckets of the window, so a hot equipment still splits across tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.ordered import DEFAULT_BUCKET_SECONDS, fill_scan, join_on_keys, suggest_bucket_seconds, time_bucket
from vigil.session import cut_lineage, ensure_checkpoint_dir

# fixed values (must equal the reference's)
COOLDOWN_DEFAULT_SECONDS = 30 * 24 * 3600
COOLDOWN_DEFAULT_THRESHOLD = 0.8


def _successors(points: DataFrame, probes: DataFrame, by: str, bucket_seconds: int) -> DataFrame:
    """For each probe (nid, by, t) the first point (by, t, tb, nid) with time > t."""
    stream = (points.select(by, "_t", F.lit(0).alias("_side"), "_tb",
                            F.col("nid").alias("_pt"), F.lit(None).cast("string").alias("_probe"))
              .unionByName(probes.select(by, "_t", F.lit(1).alias("_side"),
                                         F.lit(None).cast("long").alias("_tb"),
                                         F.lit(None).cast("string").alias("_pt"),
                                         F.col("nid").alias("_probe"))))
    order = [F.col("_t"), F.col("_side"), F.col("_tb")]
    s = fill_scan(stream, [by], order, time_bucket(F.col("_t"), bucket_seconds),
                  backward={"_next": F.col("_pt")})
    return s.filter(F.col("_side") == 1).select(F.col("_probe").alias("nid"), F.col("_next").alias("j"))


def cooldown_events(df: DataFrame, trigger: Column, by: str = "equipment_id",
                    ts: str = "timestamp", tiebreak: str = "event_id",
                    gap_seconds: int = COOLDOWN_DEFAULT_SECONDS,
                    bucket_seconds: int | None = None, max_rounds: int = 64) -> DataFrame:
    """Rows emitted by the cooldown rule, with their original columns.

    A row is emitted when ``trigger`` holds and its time is more than
    ``gap_seconds`` after the previous emission of its equipment (initially
    after the equipment's first row of ``df``).  ``tiebreak`` must be unique within an equipment;
    rows with a NULL equipment are one series.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # No wider than the densest equipment allows: a burst is split down to seconds.
    bucket_seconds = bucket_seconds or min(max(gap_seconds, 3600), suggest_bucket_seconds(df.select(by, ts), by, ts))
    gap_us = gap_seconds * 1_000_000
    series = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("none"))
    row_id = F.concat(F.lit("c:"), F.col(tiebreak).cast("long").cast("string"), F.lit(":"), series)
    # narrow projection used by every branch below: computed once, kept (recomputable) in cache
    narrow = df.select(by, F.col(ts).alias("_t"), F.col(tiebreak).cast("long").alias("_tb"),
                       trigger.alias("_trig"), row_id.alias("nid")).persist(StorageLevel.MEMORY_AND_DISK)
    cand = narrow.filter(F.col("_trig")).select(by, "_t", "_tb", "nid")
    starts = narrow.groupBy(by).agg(F.min("_t").alias("_t0")).select(
        by, F.timestamp_micros(F.unix_micros("_t0") + F.lit(gap_us)).alias("_t"),
        F.concat(F.lit("s:"), series).alias("nid"))
    probes = cand.select(by, F.timestamp_micros(F.unix_micros("_t") + F.lit(gap_us)).alias("_t"), "nid") \
        .unionByName(starts)
    # node table: (nid, j = J_k(nid), d = nid ∈ D_k); D_0 = the series starts
    succ = _successors(cand, probes, by, bucket_seconds)
    nodes = cut_lineage(succ.withColumn("d", F.col("nid").startswith("s:")))
    for _ in range(max_rounds):
        # one pass per round: J(k+1) = J(k) ∘ J(k) and D(k+1) = D(k) ∪ J(k)(D(k))
        a, b = nodes.alias("a"), nodes.alias("b")
        marks = nodes.filter(F.col("d") & F.col("j").isNotNull()).select(
            F.col("j").alias("m_nid"), F.lit(True).alias("m"))
        nxt = (a.join(b, F.col("a.j") == F.col("b.nid"), "left")
               .join(marks, F.col("a.nid") == F.col("m_nid"), "left")
               .select(F.col("a.nid").alias("nid"), F.col("b.j").alias("j"),
                       (F.col("a.d") | F.coalesce(F.col("m"), F.lit(False))).alias("d")))
        nodes = cut_lineage(nxt)
        # no node has a 2^(k+1)-step successor: every chain is shorter, D(k+1) holds it all
        if nodes.filter(F.col("j").isNotNull()).isEmpty():
            break
    else:
        raise RuntimeError("cooldown chain longer than 2**max_rounds")
    reached = nodes.filter(F.col("d")).select("nid")
    # ``nodes`` is a checkpoint: nothing below depends on the cached projection
    emitted = reached.filter(F.col("nid").startswith("c:"))
    narrow.unpersist()
    return df.join(emitted, row_id == F.col("nid"), "left_semi")


def maintenance_from_cooldown(emitted: DataFrame, flag: str = "failure_imminent",
                              by: str = "equipment_id", ts: str = "timestamp") -> DataFrame:
    """W07 output row: type corrective if the failure flag is set, else preventive."""
    return emitted.select(ts, by, F.when(F.col(flag), F.lit("corrective"))
                          .otherwise(F.lit("preventive")).alias("maintenance_type"))


def daily_spine(df: DataFrame, by: str = "equipment_id", ts: str = "timestamp",
                step: str = "1 day") -> DataFrame:
    """Timestamps first, first+step, … ≤ last per equipment."""
    rng = df.groupBy(by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return rng.select(by, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {step}"))).alias(ts))


#: Sub-buckets of a window that a frame sums row by row; beyond, blocks of them are summed.
FRAME = 64


def _divisors(n: int) -> list[int]:
    out, p = [1], 2
    while n > 1:
        if p * p > n:
            p = n
        powers = [1]
        while n % p == 0:
            n //= p
            powers.append(powers[-1] * p)
        out = [a * b for a in out for b in powers]
        p += 1
    return sorted(out)


def rolling_width(df: DataFrame, window_seconds: int, by: str, ts: str, sub_buckets: int, target_rows: int) -> int:
    """Width in microseconds of the sub-buckets of ``rolling_features``: it divides the window, and no sub-bucket of an
    equipment holds more than ``target_rows`` rows (down to single microseconds).  One number a round reaches the driver."""
    widths = _divisors(int(window_seconds) * 1_000_000)
    width = max(d for d in widths if d * max(1, int(sub_buckets)) <= widths[-1])
    while True:
        slot = F.floor(F.unix_micros(F.col(ts)) / F.lit(width)).alias("_slot")
        densest = df.filter(F.col(ts).isNotNull()).groupBy(by, slot).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
        if densest <= target_rows or width == 1:
            return width
        width = max([d for d in widths if d * -(-densest // target_rows) <= width], default=1)


def _before_totals(tot: DataFrame, by: str, m: int, n: int) -> DataFrame:
    """For each sub-bucket c of ``tot``: totals (_bn, _bs, _bx, _bi) of the sub-buckets c-m+1 .. c-1.

    Up to ``FRAME`` sub-buckets are summed by a frame over the totals, more by dyadic blocks.  Level l has the totals of blocks of 2**l sub-buckets; a range takes at most two blocks of each level.  A block
    serves at most 2**(l+1) ranges, so no key of the join is hot.
    """
    if m <= FRAME:
        frame = Window.partitionBy(by).orderBy("_sb").rangeBetween(-(m - 1), -1)
        return tot.select(by, "_sb", *[f(f"_t{k}{i}").over(frame).alias(f"_b{k}{i}") for i in range(n) for k, f in (("n", F.sum), ("s", F.sum), ("x", F.max), ("i", F.min))])
    top = m.bit_length()
    parts = [f(f"_t{k}{i}").alias(f"_t{k}{i}") for i in range(n) for k, f in (("n", F.sum), ("s", F.sum), ("x", F.max), ("i", F.min))]
    levels = tot.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(top))))
    levels = levels.groupBy(by, "_l", F.expr("shiftright(_sb, _l)").alias("_block")).agg(*parts)
    taken = []
    for level in range(top + 1):
        size = 1 << level
        # the half-open range [a, b) in blocks of this level, from which the levels below have taken odd ends
        a = F.shiftright(F.col("_sb") - (m - 1) + (size - 1), level)
        b = F.shiftright(F.col("_sb"), level)
        odd_a, odd_b = a.bitwiseAND(F.lit(1)), b.bitwiseAND(F.lit(1))
        block = lambda at: F.struct(F.lit(level).alias("_l"), at.alias("_block"))
        taken += [F.when((odd_a == 1) & (a < b), block(a)), F.when((odd_b == 1) & (a + odd_a < b), block(b - 1))]
    ranges = tot.select(by, "_sb", F.inline(F.filter(F.array(*taken), lambda x: x.isNotNull())))
    found = join_on_keys(ranges, levels, [by, "_l", "_block"], "inner")
    out = [f(f"_t{k}{i}").alias(f"_b{k}{i}") for i in range(n) for k, f in (("n", F.sum), ("s", F.sum), ("x", F.max), ("i", F.min))]
    return found.groupBy(by, "_sb").agg(*out)


ROLLING_STATS = ("mean", "max", "min", "count", "sum")


def rolling_features(df: DataFrame, columns: Sequence[str], window_seconds: int,
                     by: str = "equipment_id", ts: str = "timestamp", tiebreak: str = "event_id",
                     sub_buckets: int = 24, stats: Sequence[str] = ("mean", "max", "count"),
                     target_rows: int = 2_000_000) -> DataFrame:
    """Per row, stats of each column over the right-closed window (t - w, t] of its equipment.

    Exact and O(n log n) with no frame that slides over raw rows (Spark's
    sliding frames re-aggregate the whole frame per row).  Time is cut into
    sub-buckets of width w / m, at least ``sub_buckets`` of them and as many more as it takes for none
    to hold over ``target_rows`` rows of an equipment (``rolling_width``), so a burst is split over tasks.  A window
    (t - w, t] whose row lies in sub-bucket c is exactly

    * A: rows of sub-bucket c up to t          (running aggregate, incremental),
    * B: whole sub-buckets c-m+1 .. c-1        (totals of dyadic blocks of sub-buckets: at most 2 log2(m) of them),
    * C: rows of sub-bucket c-m after t - w    (suffix aggregate of that sub-bucket, read at
      its first row after t - w: a forward lookup through the ordered union of rows and probes).

    Partitions are (equipment, sub-bucket), so a hot equipment spreads out.
    ``tiebreak`` must identify the rows of one equipment (probe results are joined back on both).
    """
    bad = [x for x in stats if x not in ROLLING_STATS]
    if bad:
        raise ValueError(f"unsupported rolling stats {bad}; supported: {ROLLING_STATS}")
    w_us = int(window_seconds) * 1_000_000
    d_us = rolling_width(df, window_seconds, by, ts, sub_buckets, target_rows)
    m = w_us // d_us
    cols = list(columns)
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    base = df.withColumns({"_tu": F.unix_micros(F.col(ts)),
                           "_sb": F.floor(F.unix_micros(F.col(ts)) / F.lit(d_us)).cast("long")})

    def aggs(prefix: str, frame_x) -> dict:
        out = {}
        for i, c in enumerate(cols):
            v = frame_x(c)
            out[f"{prefix}n{i}"] = v(F.count(x[c]))
            out[f"{prefix}s{i}"] = v(F.sum(x[c]))
            out[f"{prefix}x{i}"] = v(F.max(x[c]))
            out[f"{prefix}i{i}"] = v(F.min(x[c]))
        return out

    # A (prefix up to t, peers included) and the suffix aggregates used by C, one partitioning
    wa = Window.partitionBy(by, "_sb").orderBy("_tu").rangeBetween(Window.unboundedPreceding, 0)
    ws = Window.partitionBy(by, "_sb").orderBy(F.col("_tu").desc()).rangeBetween(Window.unboundedPreceding, 0)
    rows = base.withColumns(aggs("_a", lambda c: (lambda e: e.over(wa))))
    rows = rows.withColumns(aggs("_z", lambda c: (lambda e: e.over(ws))))

    # B: totals per sub-bucket, then of dyadic blocks, then of the m-1 sub-buckets before each one
    tot = base.filter(F.col("_sb").isNotNull()).groupBy(by, "_sb").agg(*[e.alias(k) for k, e in aggs("_t", lambda c: (lambda e: e)).items()])
    btab = _before_totals(tot, by, m, len(cols)) if m > 1 else None

    # C: for each row, the suffix aggregate of sub-bucket c-m at its first row with time > t - w
    zfields = [F.col(f"_z{k}{i}").alias(f"{k}{i}") for i in range(len(cols)) for k in "nsxi"]
    points = rows.select(by, "_sb", "_tu", F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_pid"),
                         F.struct(*zfields).alias("_pay"))
    probes = base.select(by, (F.col("_sb") - m).alias("_sb"), (F.col("_tu") - F.lit(w_us)).alias("_tu"),
                         F.lit(1).alias("_side"), F.col(tiebreak).cast("long").alias("_pid"),
                         F.lit(None).cast(points.schema["_pay"].dataType).alias("_pay"))
    # reversed order, "unbounded preceding .. current": the first point after each probe
    wc = Window.partitionBy(by, "_sb").orderBy(F.col("_tu").desc(), F.col("_side").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    looked = points.unionByName(probes).withColumn("_c", F.last("_pay", ignorenulls=True).over(wc))
    ctab = looked.filter(F.col("_side") == 1).select(by, (F.col("_sb") + m).alias("_sb"), F.col("_pid").alias("_cid"), "_c")

    # joined inside (equipment, sub-bucket), the partitioning of the rows
    out = join_on_keys(rows.withColumn("_cid", F.col(tiebreak).cast("long")), ctab, [by, "_sb", "_cid"], "left")
    if btab is not None:
        out = join_on_keys(out, btab, [by, "_sb"], "left")

    res = {}
    for i, c in enumerate(cols):
        parts_n = [F.col(f"_an{i}"), F.col(f"_c.n{i}")] + ([F.col(f"_bn{i}")] if btab is not None else [])
        parts_s = [F.col(f"_as{i}"), F.col(f"_c.s{i}")] + ([F.col(f"_bs{i}")] if btab is not None else [])
        parts_M = [F.col(f"_ax{i}"), F.col(f"_c.x{i}")] + ([F.col(f"_bx{i}")] if btab is not None else [])
        parts_m = [F.col(f"_ai{i}"), F.col(f"_c.i{i}")] + ([F.col(f"_bi{i}")] if btab is not None else [])
        n = sum((F.coalesce(p, F.lit(0)) for p in parts_n[1:]), parts_n[0])
        tot_s = sum((F.coalesce(p, F.lit(0.0)) for p in parts_s[1:]), F.coalesce(parts_s[0], F.lit(0.0)))
        if "count" in stats:
            res[f"{c}_roll_count"] = n
        if "sum" in stats:
            res[f"{c}_roll_sum"] = F.when(n > 0, tot_s)
        if "mean" in stats:
            res[f"{c}_roll_mean"] = F.when(n > 0, tot_s / n)
        if "max" in stats:
            res[f"{c}_roll_max"] = F.greatest(*parts_M)
        if "min" in stats:
            res[f"{c}_roll_min"] = F.least(*parts_m)
    drop = [k for k in out.columns if k.startswith(("_a", "_z", "_b", "_c", "_t", "_s"))]
    return out.withColumns(res).drop(*[d for d in drop if d not in df.columns])


def corr_matrix(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """A17 (W10 with ``by``): Pearson matrix, pairwise-complete, long form (a, b, corr).

    Each row is turned into one small (pair, x, y) record per column pair inside the scan, and one hash aggregate of the
    guarded moments runs over them: its map-side table has one entry per pair (and key), so nothing but those entries is
    shuffled.  A value is used only where both columns are non-NULL.  A constant column gives NULL instead of a
    division error; values are clamped to [-1, 1]; the lower triangle mirrors the upper one.
    """
    cols = list(columns)
    keys = [by] if by else []
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    names = {c: f"_v{i}" for i, c in enumerate(cols)}
    wide = df.select(*keys, *[F.col("`" + c.replace("`", "``") + "`").cast("double").alias(n) for c, n in names.items()])
    both = lambda a, b, c: F.when(F.col(names[a]).isNotNull() & F.col(names[b]).isNotNull(), F.col(names[c]))
    records = [F.struct(F.lit(k).alias("_pair"), both(a, b, a).alias("_x"), both(a, b, b).alias("_y")) for k, (a, b) in enumerate(pairs)]
    long = wide.select(*keys, F.inline(F.array(*records)))
    r = F.try_divide(F.covar_samp("_x", "_y"), F.stddev_samp("_x") * F.stddev_samp("_y"))
    found = long.groupBy(*keys, "_pair").agg(r.alias("r"))
    r = F.when(F.col("r").isNotNull() & ~F.isnan("r"), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("r"))))
    side = lambda n: F.get(F.array(*[F.lit(p[n]) for p in pairs]), F.col("_pair"))
    upper = found.select(*keys, side(0).alias("sensor_a"), side(1).alias("sensor_b"), r.alias("corr"))
    if not keys:  # an empty table has every pair, without a value
        every = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("sensor_a"), F.lit(b).alias("sensor_b")) for a, b in pairs])))
        upper = every.join(F.broadcast(upper), ["sensor_a", "sensor_b"], "left") if pairs else upper
    both_ways = F.when(
        F.col("sensor_a") == F.col("sensor_b"),
        F.array(F.struct(F.col("sensor_a").alias("a"), F.col("sensor_b").alias("b"))),
    ).otherwise(F.array(F.struct(F.col("sensor_a").alias("a"), F.col("sensor_b").alias("b")),
                        F.struct(F.col("sensor_b").alias("a"), F.col("sensor_a").alias("b"))))
    return upper.select(*keys, F.explode(both_ways).alias("_p"), "corr").select(
        *keys, F.col("_p.a").alias("sensor_a"), F.col("_p.b").alias("sensor_b"), "corr")


def urgent_list(scored: DataFrame, n: int | None = None, id_col: str = "equipment_id",
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """All rows, the most urgent first (priority high > medium > low, then probability desc); ``n`` cuts the list."""
    rank = F.when(F.col("maintenance_priority") == "high", 1) \
        .when(F.col("maintenance_priority") == "medium", 2).otherwise(3)
    out = scored.withColumn("priority_rank", rank).orderBy(
        F.col("priority_rank"), F.col("failure_probability").desc(), F.col(id_col), *[F.col(t) for t in tiebreak])
    return out if n is None else out.limit(n)


def health_trend_daily(scored: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Daily average health with the day-over-day change and its tier (the 80/60/40 lines).

    The daily table has one row per day (bounded by the time span, not by the
    data volume), so the ``lag`` runs on a small input.
    """
    daily = scored.groupBy(F.to_date(ts).alias("day")).agg(F.avg("health_score").alias("avg_health"),
                                                           F.count(F.lit(1)).alias("n"))
    from vigil.functions.rules import health_tier
    w = Window.orderBy("day")
    return daily.withColumns({"delta": F.col("avg_health") - F.lag("avg_health").over(w),
                              "tier": health_tier(F.col("avg_health"))})


def spine_asof(spine: DataFrame, readings: DataFrame, columns: Sequence[str],
               by: str = "equipment_id", ts: str = "timestamp",
               tiebreak: Sequence[str] = (), bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """W08 + J01: spine points enriched with the last reading at or before them."""
    from vigil.operators.asof import asof_join
    right = readings.select(by, ts, *tiebreak, *columns)
    return asof_join(spine, right, on=ts, by=[by], right_tiebreak=list(tiebreak), bucket_seconds=bucket_seconds)


__all__ = ["cooldown_events", "maintenance_from_cooldown", "daily_spine", "rolling_features",
           "corr_matrix", "urgent_list", "health_trend_daily", "spine_asof", "join_on_keys"]
