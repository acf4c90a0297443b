"""Output shaping shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.sources.tables import to_output

DIGITS = 6


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles (float sums differ in the last bits between engines) and
    return zone-less timestamps."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(c, digits).alias(f.name))
        else:
            cols.append(c)
    return to_output(df.select(*cols))
