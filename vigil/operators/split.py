"""Deterministic train/test split.

Row-stable: a row's side depends only on its key and the seed (``xxhash64``),
not on partitioning, so re-running a job (or losing an executor) never moves a
row.  Sizes follow the reference: test = ceil(fraction * n), per stratum when
stratified; a stratum of one row goes to train.  The k-th smallest hash per stratum is found
without sorting a whole stratum: hashes are bucketed by their top 16 bits, bucket counts (at most
65,536 per stratum) give each bucket's rank range, and rows are ranked inside their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.ordered import join_on_keys

# fixed values (must equal the reference's)
TEST_FRACTION = 0.2
SPLIT_SEED = 42
STRATUM_CANDIDATES = ("failure", "failure_imminent", "target", "label", "failure_probability")

_HB_SHIFT = 48


def pick_stratum(labels: DataFrame) -> str | None:
    """First of the candidate label columns present."""
    for c in STRATUM_CANDIDATES:
        if c in labels.columns:
            return c
    return None


def split(df: DataFrame, key: Sequence[str] | str, strata: str | None = None,
          test_fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED,
          out: str = "split") -> DataFrame:
    """Add ``out`` = 'test' / 'train'; test = the ceil(fraction*n) smallest hashes per stratum."""
    keys = [key] if isinstance(key, str) else list(key)
    h = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    s_cols = [strata] if strata else []
    d = df.withColumn("_h", h).withColumn("_hb", F.shiftright(F.col("_h"), _HB_SHIFT))
    cnt = d.groupBy(*s_cols, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*s_cols).orderBy("_hb")
    cnt = cnt.withColumns({
        "_before": F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_n": F.sum("_c").over(Window.partitionBy(*s_cols)),
    })
    k = F.ceil(F.lit(float(test_fraction)) * F.col("_n")).cast("long")
    if strata:  # a stratum of one row trains
        k = F.when(F.col("_n") > 1, k).otherwise(F.lit(0))
    # rows are ranked inside their hash bucket, which holds some n / 65,536 rows of a stratum
    rank = F.row_number().over(Window.partitionBy(*s_cols, "_hb").orderBy("_h", *keys))
    ranked = d.withColumn("_rank", rank)
    j = join_on_keys(ranked, cnt.select(*s_cols, "_hb", "_before", k.alias("_k")), [*s_cols, "_hb"], "left")
    side = F.when(F.col("_before") + F.col("_rank") <= F.col("_k"), F.lit("test")).otherwise(F.lit("train"))
    return j.withColumn(out, side).drop("_h", "_hb", "_rank", "_before", "_k")


def split_sizes(df: DataFrame, strata: str | None = None, out: str = "split") -> DataFrame:
    """Rows per (stratum, side)."""
    cols = [strata, out] if strata else [out]
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
