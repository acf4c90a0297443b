"""The next row in a global order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most this many ranges; beyond it the ranges grow.
MOST_RANGES = 20_000


def range_number(df: DataFrame, key: str, rows_per_range: int) -> Column:
    """A number that ascends with the integer column ``key``; each number holds about ``rows_per_range`` rows.

    The bounds are approximate quantiles of the key, one aggregate row; NULL keys fall into the lowest range.
    The bounds are searched in two levels, so an expression looks at about twice the root of their number.
    """
    n = min(MOST_RANGES, df.count() // rows_per_range)
    if n < 2:
        return F.lit(0)
    got = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0]
    bounds = sorted(set(got or []))
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k:k + width] for k in range(0, len(bounds), width)]
    ends = F.lit([g[-1] for g in groups])
    above = F.size(F.filter(ends, lambda b: F.col(key) > b))
    inner = F.get(F.lit([g for g in groups]), above)
    return F.coalesce(above * width + F.coalesce(F.size(F.filter(inner, lambda b: F.col(key) > b)), F.lit(0)), F.lit(0))
