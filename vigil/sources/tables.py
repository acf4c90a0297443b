"""Parquet table access with ingest-edge normalisation.

Two fixes happen at every ingest edge so no operator has to think about them:

* zone-less parquet timestamps (``timestamp_ntz``) become ``TIMESTAMP`` in the
  session time zone (UTC in our sessions), because ``unix_micros`` and friends
  reject ``timestamp_ntz``;
* floating ``NaN`` becomes ``NULL``: pandas treats NaN as missing, Spark does
  not (``NaN > 5`` is true and ``avg`` returns NaN).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_ingest(df: DataFrame) -> DataFrame:
    """Cast timestamp_ntz → timestamp and NaN → NULL (one projection)."""
    cols: list[Column] = []
    changed = False
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampNTZType):
            cols.append(c.cast("timestamp").alias(f.name))
            changed = True
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(~F.isnan(c), c).alias(f.name))
            changed = True
        else:
            cols.append(c)
    return df.select(*cols) if changed else df


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``; optional column list keeps the scan narrow."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return normalize_ingest(df)


def to_output(df: DataFrame) -> DataFrame:
    """Return timestamps zone-less again so results do not depend on the reader's zone."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            cols.append(c.cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)
