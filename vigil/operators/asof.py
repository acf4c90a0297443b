"""Backward as-of join (``merge_asof`` semantics) without a range join.

Both sides are unioned into one ordered stream per ``by`` key; each left row
takes the last right row at or before it.  At equal timestamps right rows sort
before left rows (an exact match is allowed) and, among right rows, the last by
``right_tiebreak`` wins.  The right row is carried as one ``struct`` so a NULL
attribute of the matched row stays NULL instead of reaching further back.

Cost: one union, an in-bucket window and a tiny bucket summary (see
``ordered.fill_scan``) — O(N log N), no non-equi join, hot keys split by time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.ordered import DEFAULT_BUCKET_SECONDS, fill_scan, time_bucket

_SIDE = "_asof_side"
_MATCH = "_asof_match"


class AsOfKeyError(ValueError):
    """Raised when the as-of inputs cannot be joined (missing key / bad type)."""


def _validate(left: DataFrame, right: DataFrame, on: str, by: Sequence[str]) -> None:
    for side, df in (("left", left), ("right", right)):
        names = set(df.columns)
        for k in [on, *by]:
            if k not in names:
                raise AsOfKeyError(f"{side} side has no column {k!r}")
        dt = df.schema[on].dataType
        if not isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType, T.NumericType)):
            raise AsOfKeyError(f"{side} column {on!r} is {dt.simpleString()}, not orderable time")


def asof_join(left: DataFrame, right: DataFrame, on: str = "timestamp",
              by: Sequence[str] | str = ("equipment_id",),
              left_tiebreak: Sequence[str] | str = (),
              right_tiebreak: Sequence[str] | str = (),
              suffixes: tuple[str, str] = ("_x", "_y"),
              bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
              on_error: str = "raise") -> DataFrame:
    """Left-outer backward as-of join of ``left`` with ``right`` on ``on`` within ``by``.

    Output: every left column, then right's non-key columns (clashing names get
    ``suffixes``).  Left rows with a NULL ``on`` value stay unmatched.
    ``on_error='left'`` mimics the reference's fallback (left rows only) when
    the inputs cannot be joined; the default raises.
    """
    by = [by] if isinstance(by, str) else list(by)
    ltb = [left_tiebreak] if isinstance(left_tiebreak, str) else list(left_tiebreak)
    rtb = [right_tiebreak] if isinstance(right_tiebreak, str) else list(right_tiebreak)
    try:
        _validate(left, right, on, by)
    except AsOfKeyError:
        if on_error == "left":
            return left
        raise

    keys = set([on, *by])
    rcols = [c for c in right.columns if c not in keys]
    lnames = set(left.columns)
    out_names = {}
    for c in rcols:
        out_names[c] = c + suffixes[1] if c in lnames else c
    lrename = {c: c + suffixes[0] for c in left.columns if c in rcols}

    is_time = isinstance(left.schema[on].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    def order_key(c):
        return F.col(c).cast("timestamp") if is_time else F.col(c).cast("double")

    # the ordered stream: (by..., _t, side, tiebreak..., payload)
    lt = [F.col(c).alias(f"_lt{i}") for i, c in enumerate(ltb)]
    rt = [F.col(c).alias(f"_rt{i}") for i, c in enumerate(rtb)]
    payload_fields = [F.col(c).alias(f"_p{i}") for i, c in enumerate(rcols)]
    lrow = left.select(*[F.col(c).alias(f"_l_{c}") for c in left.columns],
                       *[F.col(b).alias(f"_k_{b}") for b in by],
                       order_key(on).alias("_t"), F.lit(1).alias(_SIDE), *lt)
    rrow = right.select(*[F.col(b).alias(f"_k_{b}") for b in by],
                        order_key(on).alias("_t"), F.lit(0).alias(_SIDE), *rt,
                        F.struct(*payload_fields).alias("_payload"))
    rrow = rrow.filter(F.col("_t").isNotNull())
    stream = lrow.unionByName(rrow, allowMissingColumns=True)

    kb = [f"_k_{b}" for b in by]
    tb_cols = [F.col(f"_rt{i}") for i in range(len(rtb))] + [F.col(f"_lt{i}") for i in range(len(ltb))]
    order = [F.col("_t"), F.col(_SIDE), *tb_cols]
    if is_time:
        bucket = time_bucket(F.col("_t"), bucket_seconds)
    else:
        bucket = F.floor(F.col("_t") / F.lit(float(bucket_seconds))).cast("long")
    scanned = fill_scan(stream, kb, order, bucket, forward={_MATCH: F.col("_payload")})
    result = scanned.filter(F.col(_SIDE) == 1)
    # left rows with NULL time never match
    match = F.when(F.col("_t").isNotNull(), F.col(_MATCH))
    sel = [F.col(f"_l_{c}").alias(lrename.get(c, c)) for c in left.columns]
    sel += [match.getField(f"_p{i}").alias(out_names[c]) for i, c in enumerate(rcols)]
    return result.select(*sel)
