"""Skew-safe ordered scans: positions, forward fill and backward fill per key.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one
task; one hot equipment holding a third of the table would then serialise the
job.  These helpers split each key into coarse *order buckets* (time buckets by
default), do the scan inside ``(key, bucket)`` partitions, and stitch buckets
together through a per-bucket summary that has one row per ``(key, bucket)``:

1. in-bucket window  (shuffle on ``key, bucket`` — a hot key spreads out),
2. bucket summary    (a grouped count where only positions are wanted, else the last
   and first row of each bucket),
3. carry across buckets with a window over the summary (tiny),
4. equi-join the carry back on ``(key, bucket)`` (AQE broadcasts it when the
   measured summary is small; otherwise a shuffle join without hot keys).

The answer is exactly the one of the single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_obkt"
# order value standing in for a NULL bucket (NULL times sort first); far from real buckets
_NULL_BUCKET = -(2 ** 62)

# Default order-bucket width for timestamp keys: one day.
DEFAULT_BUCKET_SECONDS = 86400


def time_bucket(ts: Column | str, width_seconds: int = DEFAULT_BUCKET_SECONDS) -> Column:
    """Integer bucket of a TIMESTAMP column (floor of epoch micros / width)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c) / F.lit(width_seconds * 1_000_000)).cast("long")


def _keys(by: Sequence[str] | str | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join treating NULL keys as equal (pandas groups NULL keys together)."""
    r = right
    ren = {}
    for k in keys:
        ren[k] = f"_r_{k}"
        r = r.withColumnRenamed(k, ren[k])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[ren[k]])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*ren.values())


#: Copies of a per-key summary that ``join_salted`` deals a key's rows over.
SALTS = 32


def join_salted(left: DataFrame, summary: DataFrame, keys: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join of rows with a summary that has one row per key (NULL keys equal), without a hot partition.

    The summary is copied to every salt and the rows are dealt over the salts by a hash of the whole row, so a key with a
    third of all rows meets ``salts`` tasks.  A summary small enough is broadcast by the optimizer as any other side.
    """
    hashable = [F.col(f"`{f.name}`") for f in left.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
    copies = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_on_keys(dealt, copies, [*keys, "_salt"], how).drop("_salt")


def with_bucket(df: DataFrame, bucket: Column) -> DataFrame:
    return df.withColumn(BUCKET, bucket)


def ordered_scan(df: DataFrame, by, order: Sequence[Column], bucket: Column,
                 forward: dict[str, Column] | None = None,
                 backward: dict[str, Column] | None = None,
                 position: str | None = None, with_positions: bool = False,
                 group_count: str | None = None) -> DataFrame:
    """One skew-safe ordered pass: positions, forward fills and backward fills.

    * ``position``: name of a 0-based row-position column inside each ``by`` group;
    * ``forward[name] = expr``: value of ``expr`` on the last row at or before the
      current one whose ``expr`` is not NULL;
    * ``backward[name] = expr``: the same for the first row at or after it;
    * ``with_positions``: fills become ``struct(p, v)`` with ``p`` the global
      position of the row the value came from;
    * ``group_count``: name of a column with the row count of the row's ``by``
      group (read off the bucket summary: no aggregate joined back on a hot key).

    ``order`` holds plain ascending expressions (NULLs first) ending in a unique
    tiebreak; ``bucket`` must be monotone in ``order``.  One shuffle and sort on
    ``(by, bucket)``; the bucket summary (last / first row of every bucket) turns
    bucket-local row numbers into global positions and carries values across
    buckets; it is joined back on ``(by, bucket)``.
    """
    forward = forward or {}
    backward = backward or {}
    keys = _keys(by)
    if not forward and not backward:
        return _positions(df, keys, order, bucket, position, group_count)
    b = with_bucket(df, bucket)
    w = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    l1 = b.withColumns({"_rn": F.row_number().over(w), "_nx": F.lead(F.lit(1)).over(w)})

    def payload(expr: Column) -> Column:
        val = F.struct(F.col("_rn").alias("p"), expr.alias("v")) if with_positions else expr
        return F.when(expr.isNotNull(), val)

    # Frames always run "unbounded preceding .. current row", which Spark evaluates
    # incrementally; a frame reaching to "unbounded following" is re-aggregated for
    # every row (quadratic in the partition).  Backward fills therefore run as
    # forward fills over the reversed order (same partitioning: one more sort, no shuffle).
    w_rev = Window.partitionBy(*keys, BUCKET).orderBy(*[o.desc_nulls_last() for o in order])
    cols = {}
    for name, expr in forward.items():
        cols[f"_lf_{name}"] = F.last(payload(expr), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0))
    for name, expr in backward.items():
        cols[f"_lb_{name}"] = F.last(payload(expr), ignorenulls=True).over(
            w_rev.rowsBetween(Window.unboundedPreceding, 0))
    local = l1.withColumns(cols) if cols else l1

    need_off = bool(position) or with_positions or bool(group_count)
    is_last, is_first = F.col("_nx").isNull(), F.col("_rn") == 1
    ob = F.coalesce(F.col(BUCKET), F.lit(_NULL_BUCKET))
    summ = local.filter(is_last | is_first).select(
        *keys, BUCKET, ob.alias("_ob"), "_rn", is_last.alias("_il"), is_first.alias("_if"),
        *[f"_lf_{n}" for n in forward], *[f"_lb_{n}" for n in backward])
    wk = Window.partitionBy(*keys).orderBy("_ob")
    before = wk.rangeBetween(Window.unboundedPreceding, -1)
    # later buckets, as a "preceding" frame of the descending order (linear, see above)
    after = Window.partitionBy(*keys).orderBy(F.col("_ob").desc()).rangeBetween(Window.unboundedPreceding, -1)
    if need_off:
        summ = summ.withColumn(
            "_off", F.coalesce(F.sum(F.when(F.col("_il"), F.col("_rn"))).over(before), F.lit(0)))
    if group_count:
        summ = summ.withColumn("_gcnt", F.sum(F.when(F.col("_il"), F.col("_rn"))).over(
            Window.partitionBy(*keys)))

    def globalize(c: Column) -> Column:
        # bucket-local (p, v) → global (p, v) using this bucket's offset
        if not with_positions:
            return c
        return F.when(c.isNotNull(), F.struct((F.col("_off") + c.getField("p") - 1).alias("p"),
                                              c.getField("v").alias("v")))

    carry = {}
    for n in forward:
        carry[f"_cf_{n}"] = F.last(F.when(F.col("_il"), globalize(F.col(f"_lf_{n}"))),
                                   ignorenulls=True).over(before)
    for n in backward:
        carry[f"_cb_{n}"] = F.last(F.when(F.col("_if"), globalize(F.col(f"_lb_{n}"))),
                                   ignorenulls=True).over(after)
    if not carry and not need_off:
        return local.drop("_rn", "_nx", BUCKET)
    keep = (["_off"] if need_off else []) + (["_gcnt"] if group_count else [])
    summary = (summ.withColumns(carry) if carry else summ).filter(F.col("_il")).select(
        *keys, BUCKET, *keep, *carry.keys())

    res = join_on_keys(local, summary, [*keys, BUCKET], "left")
    outs = {}
    if position:
        outs[position] = F.col("_off") + F.col("_rn") - 1
    if group_count:
        outs[group_count] = F.col("_gcnt")
    for n in forward:
        outs[n] = F.coalesce(globalize(F.col(f"_lf_{n}")), F.col(f"_cf_{n}"))
    for n in backward:
        outs[n] = F.coalesce(globalize(F.col(f"_lb_{n}")), F.col(f"_cb_{n}"))
    drop = [c for c in res.columns if c.startswith(("_lf_", "_lb_", "_cf_", "_cb_"))]
    return res.withColumns(outs).drop(*drop, "_off", "_gcnt", "_rn", "_nx", BUCKET)


def _positions(df: DataFrame, keys: list[str], order: Sequence[Column], bucket: Column,
               position: str | None, group_count: str | None) -> DataFrame:
    """Row positions alone: the bucket summary is a count with map-side combine, so raw rows move once."""
    b = with_bucket(df, bucket)
    counts = b.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(*keys).orderBy(F.coalesce(F.col(BUCKET), F.lit(_NULL_BUCKET)))
    summary = counts.withColumn("_off", F.sum("_n").over(wk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    if group_count:
        summary = summary.withColumn("_gcnt", F.sum("_n").over(Window.partitionBy(*keys)))
    local = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(*order)))
    res = join_on_keys(local, summary.drop("_n"), [*keys, BUCKET], "left")
    outs = {}
    if position:
        outs[position] = F.col("_off") + F.col("_rn") - 1
    if group_count:
        outs[group_count] = F.col("_gcnt")
    return res.withColumns(outs).drop("_off", "_gcnt", "_rn", BUCKET)


def positions(df: DataFrame, by, order: Sequence[Column], bucket: Column,
              out: str = "_pos", count: str | None = None) -> DataFrame:
    """0-based row position inside each ``by`` group in ``order`` (see ``ordered_scan``);
    ``count`` also adds the group's row count."""
    return ordered_scan(df, by, order, bucket, position=out, group_count=count)


def fill_scan(df: DataFrame, by, order: Sequence[Column], bucket: Column,
              forward: dict[str, Column] | None = None,
              backward: dict[str, Column] | None = None) -> DataFrame:
    """Forward / backward fill of non-NULL values per ``by`` group (see ``ordered_scan``)."""
    return ordered_scan(df, by, order, bucket, forward=forward, backward=backward)


_DEC = "decimal(38,0)"


def packed_order(ts: Column, tiebreak: Column | None = None) -> Column:
    """(timestamp, integral tiebreak) as one DECIMAL(38,0) that sorts the same way.

    ``max_by(x, struct(ts, tb))`` needs a struct aggregation buffer, which Spark
    can only run as a sort-based aggregate (a full map-side sort).  One decimal
    key keeps ``max_by`` / ``min_by`` in the hash aggregate:
    key = micros(ts) * 2^64 + (tb + 2^63), |key| < 10^35.
    """
    t = F.unix_micros(ts).cast(_DEC)
    if tiebreak is None:
        return t
    shifted = tiebreak.cast(_DEC) + F.lit(Decimal(2 ** 63)).cast(_DEC)
    return (t * F.lit(Decimal(2 ** 64)).cast(_DEC) + shifted).cast(_DEC)


def suggest_bucket_seconds(df: DataFrame, by, ts: str, target_rows: int = 2_000_000) -> int:
    """Order-bucket width of which no bucket of any key holds more than ``target_rows`` rows.

    Rows are counted per key and hour; with at most ``m`` in an hour, ``target_rows / m`` hours hold no more than
    ``target_rows``.  Where one hour holds more than that, rows are counted per second, so a burst is split down
    to single seconds.  One number reaches the driver; rows without a time are left out.
    """
    keys = _keys(by)
    for unit in (3600, 1):
        slot = F.floor(F.unix_micros(F.col(ts)) / F.lit(unit * 1_000_000)).alias("_slot")
        counts = df.filter(F.col(ts).isNotNull()).groupBy(*keys, slot).agg(F.count(F.lit(1)).alias("_n"))
        densest = counts.agg(F.max("_n")).first()[0] or 1
        if densest <= target_rows:
            return unit * (target_rows // densest)
    return 1
