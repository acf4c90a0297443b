"""Dataset profile and inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.rules import failure_keyword

# fixed values (must equal the reference's)
PROFILE_SKIP_TERMS = ("failure", "fail", "degradation")
FAILURE_NAME_TERMS = ("failure", "fail")
TOP_VALUES = 10


def dataset_profile(df: DataFrame, by: str = "equipment_id", ts: str = "timestamp",
                    approximate: bool = False) -> DataFrame:
    """Distinct equipment, rows, first and last timestamp (one pass)."""
    distinct = F.approx_count_distinct(by) if approximate else F.count_distinct(F.col(by))
    return df.agg(distinct.alias("equipment_count"), F.count(F.lit(1)).alias("record_count"),
                  F.min(ts).alias("first_timestamp"), F.max(ts).alias("last_timestamp"))


def failure_columns(df: DataFrame) -> list[str]:
    """columns whose name mentions failure / fail."""
    return [c for c in df.columns if any(t in c.lower() for t in FAILURE_NAME_TERMS)]


def failure_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Failure rate in percent per failure column (long form).

    Boolean / numeric columns: mean * 100 (A09).  Text columns: share of rows
    whose value matches the failure keywords (F08); NULL counts in the
    denominator but never as a failure.
    """
    cols = list(columns) if columns is not None else failure_columns(df)
    rows = []
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, (T.BooleanType, T.NumericType)):
            rate = F.avg(F.col(c).cast("double")) * 100.0
            kind = "numeric"
        else:
            rate = F.try_divide(F.count_if(failure_keyword(F.col(c))) * 100.0, F.count(F.lit(1)))
            kind = "text"
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"),
                             rate.alias("failure_rate_pct")))
    return df.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


def value_distribution(df: DataFrame, column: str, top: int = TOP_VALUES) -> DataFrame:
    """Top values by count (ties by value); NULL is not a value here."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(column).asc()).limit(top))


def numeric_summary(df: DataFrame, skip_terms: Sequence[str] = PROFILE_SKIP_TERMS) -> DataFrame:
    """Mean and sample std of each numeric column not named like a target (long form)."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType)
            and not any(t in f.name.lower() for t in skip_terms)]
    rows = [F.struct(F.lit(c).alias("column"), F.avg(F.col(f"`{c}`").cast("double")).alias("mean"),
                     F.stddev_samp(F.col(f"`{c}`").cast("double")).alias("std")) for c in cols]
    return df.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


def distinct_equipment(df: DataFrame, by: str = "equipment_id") -> DataFrame:
    """A22 / U02."""
    return df.select(by).distinct()


def invalid_timestamp_count(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """Rows whose text timestamp does not parse (coercing parse gives NULL)."""
    parsed = F.try_to_timestamp(F.col(column).cast("string"), F.lit(fmt)) if fmt else \
        F.try_to_timestamp(F.col(column).cast("string"))
    return df.agg(F.count_if(parsed.isNull()).alias("invalid_timestamps"),
                  F.count(F.lit(1)).alias("rows"))


def preview(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """First n rows in an explicit order (top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)
