"""Missing values and outliers.

* ``interpolate_linear``: linear fill by row position, trailing NULLs take the
  last value, then a back-fill for leading NULLs — exactly pandas'
  ``interpolate(method='linear')`` followed by ``bfill``.  Runs through the
  skew-safe ordered scan, per equipment (default) or table-wide.
* ``exact_medians``: exact (interpolated) medians without collecting a column:
  repeated equal-width histograms, of all columns in one pass, narrow the candidate ranges.
* ``remove_outliers``: the sequential per-column z-score filter.  Each column's
  moments are computed on the rows that survived the previous columns (one
  small aggregate per column, applied as literals, so the plan grows linearly).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.features import numeric_columns
from vigil.operators.ordered import DEFAULT_BUCKET_SECONDS, ordered_scan, suggest_bucket_seconds, time_bucket

# fixed values (must equal the reference's)
ZSCORE_THRESHOLD = 3.0
ZSCORE_MIN_COUNT = 10

# histogram rows per open value and pass of the exact median
MEDIAN_BINS = 4096


def _order(ts: str, tiebreak: Sequence[str]) -> list[Column]:
    return [F.col(ts), *[F.col(t) for t in tiebreak]]


def interpolate_linear(df: DataFrame, columns: Sequence[str] | None = None,
                       by: str | None = "equipment_id", ts: str = "timestamp",
                       tiebreak: Sequence[str] = (), backfill: bool = True,
                       bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """W01 (+ W02 when ``backfill``): fill NULLs linearly by row position.

    ``by=None`` interpolates table-wide in (ts, tiebreak) order, which is what
    the reference does on its row order; the default works per equipment.
    """
    exclude = ([by] if by else []) + list(tiebreak)
    cols = list(columns) if columns is not None else numeric_columns(df, exclude=exclude)
    keys = [by] if by else []
    order = _order(ts, tiebreak)
    bucket = time_bucket(F.col(ts), bucket_seconds)
    vals = {f"_iv{i}": F.col(c).cast("double") for i, c in enumerate(cols)}
    # one ordered pass: global position of each row and of the previous / next non-NULL value
    s = ordered_scan(df, keys, order, bucket,
                     forward={f"_ip{i}": v for i, v in enumerate(vals.values())},
                     backward={f"_in{i}": v for i, v in enumerate(vals.values())},
                     position="_ipos", with_positions=True)
    out = {}
    for i, c in enumerate(cols):
        prev, nxt = F.col(f"_ip{i}"), F.col(f"_in{i}")
        interp = F.when(
            prev.isNotNull() & nxt.isNotNull() & (nxt.getField("p") != prev.getField("p")),
            prev.getField("v") + (nxt.getField("v") - prev.getField("v"))
            * (F.col("_ipos") - prev.getField("p")) / (nxt.getField("p") - prev.getField("p")))
        parts = [F.col(c).cast("double"), interp, prev.getField("v")]
        if backfill:
            parts.append(nxt.getField("v"))
        out[c] = F.coalesce(*parts)
    drop = ["_ipos", *[f"_ip{i}" for i in range(len(cols))], *[f"_in{i}" for i in range(len(cols))]]
    return s.withColumns(out).drop(*drop)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row, NULL count per column plus the total."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    exprs = [F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in cols]
    total = sum((F.col(f"`{c}`") for c in cols), F.lit(0))
    return df.agg(*exprs).withColumn("total_missing", total)


def _kth_of_distinct(values: DataFrame, k: int) -> float:
    """k-th smallest by the running count of distinct values; used where a range spans only neighbouring doubles."""
    counts = values.groupBy("_v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("_v"))
    return counts.withColumn("_upto", upto).filter(F.col("_upto") > k).agg(F.min("_v")).first()[0]


@dataclass
class _Target:
    """The k-th (0-based) smallest finite value of a column, known to lie in [lo, hi] with ``below`` values under lo."""
    column: int
    k: int
    lo: float
    hi: float
    below: int = 0


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median (mean of the two middle values when n is even) of several columns.

    One pass reads the extremes of all columns; each further pass histograms the open range of every
    middle value into ``MEDIAN_BINS`` equal widths and narrows it to one bin's own extremes, until one value is
    left.  A pass that cannot narrow a range (neighbouring doubles) counts its few distinct values instead.
    At most ``MEDIAN_BINS`` rows per open value reach the driver.  NaN counts as NULL.
    """
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    narrow = df.select(*[F.when(~F.isnan(v), v).alias(f"_v{i}") for i, v in enumerate(x)]).persist(StorageLevel.MEMORY_AND_DISK)
    inf = float("inf")
    try:
        stats = []
        for i in range(len(columns)):
            v = F.col(f"_v{i}")
            finite = F.when((v > -inf) & (v < inf), v)
            stats += [F.count(v).alias(f"n{i}"), F.count_if(v == -inf).alias(f"a{i}"), F.count_if(v == inf).alias(f"z{i}"),
                      F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}")]
        row = narrow.agg(*stats).first() if stats else None
        found: dict[tuple[int, int], float] = {}
        todo: list[_Target] = []
        middles = {}
        for i in range(len(columns)):
            n, first, last = row[f"n{i}"], row[f"a{i}"], row[f"z{i}"]
            middles[i] = sorted({(n - 1) // 2, n // 2}) if n else []
            for k in middles[i]:  # infinities lie at the ends
                if k < first:
                    found[i, k] = -inf
                elif k >= n - last:
                    found[i, k] = inf
                else:
                    todo.append(_Target(i, k, row[f"lo{i}"], row[f"hi{i}"], first))
        while todo:
            open_ = []
            for t in todo:
                width = (t.hi / 2 - t.lo / 2) / MEDIAN_BINS  # halves keep the width finite on any range
                if t.lo == t.hi:
                    found[t.column, t.k] = t.lo
                elif width <= 0.0 or t.lo / 2 + width == t.lo / 2:
                    v = F.col(f"_v{t.column}")
                    found[t.column, t.k] = _kth_of_distinct(narrow.filter(v.between(t.lo, t.hi)).select(v.alias("_v")), t.k - t.below)
                else:
                    open_.append((t, width))
            if not open_:
                break
            cells = []
            for number, (t, width) in enumerate(open_):
                v = F.col(f"_v{t.column}")
                b = F.least(F.greatest(F.floor((v / 2 - F.lit(t.lo / 2)) / F.lit(width)), F.lit(0)), F.lit(MEDIAN_BINS - 1)).cast("int")
                cells.append(F.when(v.between(t.lo, t.hi), F.struct(F.lit(number).alias("t"), b.alias("b"), v.alias("v"))))
            hist = (narrow.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("t", "b")
                    .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
            todo = []
            for number, (t, _) in enumerate(open_):
                below, was = t.below, (t.lo, t.hi)
                for r in sorted((r for r in hist if r["t"] == number), key=lambda r: r["b"]):
                    if t.k < below + r["n"]:
                        t = _Target(t.column, t.k, r["lo"], r["hi"], below)
                        break
                    below += r["n"]
                if (t.lo, t.hi) == was:  # a pass must narrow the range
                    v = F.col(f"_v{t.column}")
                    found[t.column, t.k] = _kth_of_distinct(narrow.filter(v.between(t.lo, t.hi)).select(v.alias("_v")), t.k - t.below)
                else:
                    todo.append(t)
        out: dict[str, float | None] = {}
        for i, c in enumerate(columns):
            values = [found[i, k] for k in middles[i]]
            out[c] = None if not values else values[0] if values[0] == values[-1] else (values[0] + values[-1]) / 2.0
        return out
    finally:
        narrow.unpersist()


def exact_median(df: DataFrame, column: str) -> float | None:
    """A14 for one column."""
    return exact_medians(df, [column])[column]


def median_impute(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A14 branch of E01: NULL → table-wide exact median, per column."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    out = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)) for c, m in exact_medians(df, cols).items() if m is not None}
    return df.withColumns(out) if out else df


def handle_missing(df: DataFrame, method: str = "interpolate", columns: Sequence[str] | None = None,
                   by: str | None = "equipment_id", ts: str = "timestamp",
                   tiebreak: Sequence[str] = (), bucket_seconds: int | None = None) -> DataFrame:
    """Interpolation + back-fill, or median imputation; the bucket width follows the density unless it is given."""
    if method == "interpolate":
        width = bucket_seconds or suggest_bucket_seconds(df, by, ts)
        return interpolate_linear(df, columns, by=by, ts=ts, tiebreak=tiebreak, bucket_seconds=width)
    return median_impute(df, columns)


@dataclass
class OutlierReport:
    """Rows before / after the filter."""
    rows_in: int
    rows_out: int

    @property
    def removed(self) -> int:
        return self.rows_in - self.rows_out


def remove_outliers(df: DataFrame, columns: Sequence[str] | None = None,
                    threshold: float = ZSCORE_THRESHOLD, min_count: int = ZSCORE_MIN_COUNT,
                    persist: bool = True) -> DataFrame:
    """sequential population z-score filter.

    For each column in order, over the rows that survived earlier columns:
    skip the column when it has <= ``min_count`` non-NULLs; otherwise keep rows
    with a non-NULL value and |z| < ``threshold`` (all non-NULL rows when the
    column is constant, where z is undefined).  Rows NULL in a processed column
    are dropped, as in the reference code.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    # the statistics passes only need the filtered columns: a narrow projection is
    # cached for them and released afterwards; the result is a plain filter of ``df``
    narrow = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_z{i}") for i, c in enumerate(cols)])
    if persist:
        narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    keep_all = F.lit(True)
    keep_narrow = F.lit(True)
    try:
        for i, c in enumerate(cols):
            z = F.col(f"_z{i}")
            st = narrow.filter(keep_narrow).agg(
                F.count(z).alias("n"), F.avg(z).alias("mu"), F.stddev_pop(z).alias("sd"),
                F.min(z).alias("mn"), F.max(z).alias("mx")).first()
            if st["n"] <= min_count:
                continue
            x = F.col(f"`{c}`").cast("double")

            def keep(v):
                if st["mn"] == st["mx"]:
                    return v.isNotNull()
                return v.isNotNull() & (F.abs((v - F.lit(st["mu"])) / F.lit(st["sd"])) < threshold)

            keep_all = keep_all & keep(x)
            keep_narrow = keep_narrow & keep(z)
    finally:
        if persist:
            narrow.unpersist()
    return df.filter(keep_all)


def outlier_report(before: DataFrame, after: DataFrame) -> OutlierReport:
    """A13 counts (two count actions)."""
    return OutlierReport(before.count(), after.count())


def clean_and_preprocess(sensor: DataFrame, operational: DataFrame | None = None,
                         method: str = "interpolate", by: str = "equipment_id",
                         ts: str = "timestamp", tiebreak: Sequence[str] = (),
                         operational_tiebreak: Sequence[str] = (),
                         interpolate_by: str | None = "equipment_id",
                         outlier_columns: Sequence[str] | None = None,
                         bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
                         zscore_threshold: float = ZSCORE_THRESHOLD) -> DataFrame:
    """Handle missing → remove outliers → as-of enrich with operational context.

    The filled table is read by every z-score pass and by the output, so it is
    written once to the shared checkpoint folder (the reference writes its
    cleaned table too) instead of being recomputed per pass.
    """
    from vigil.operators.asof import asof_join
    from vigil.session import cut_lineage
    if method == "interpolate":
        filled = interpolate_linear(sensor, None, by=interpolate_by, ts=ts, tiebreak=tiebreak,
                                    bucket_seconds=bucket_seconds)
    else:
        filled = median_impute(sensor)
    filled = cut_lineage(filled)
    cols = outlier_columns if outlier_columns is not None else numeric_columns(filled)
    cleaned = remove_outliers(filled, cols, threshold=zscore_threshold, persist=False)
    if operational is None:
        return cleaned
    return asof_join(cleaned, operational, on=ts, by=[by], left_tiebreak=tiebreak,
                     right_tiebreak=operational_tiebreak, bucket_seconds=bucket_seconds)
