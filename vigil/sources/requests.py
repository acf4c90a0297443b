"""Scoring requests from JSON files, one request per line, with a table of rejects.

A line is either one reading (the single form, without an equipment id) or an array of readings (the batch form, where each
has one).  Lines are parsed permissively: a line or element that is no JSON object is ``malformed``, one that lacks a
mandatory field ``incomplete``, one whose field is no finite number ``wrong type``; the others are requests.  Numbers
written as text are numbers, unknown fields are left out.  Nothing is lost: every line and every element of an array is a
request or a reject.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir

#: The sensors of a request.
REQUEST_SENSORS = ("vibration", "temperature", "pressure", "current", "rpm", "tool_wear")
_PERMISSIVE = {"mode": "PERMISSIVE"}


def _finite(text: Column) -> Column:
    """The finite number that a text holds, else NULL."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def parse_requests(lines: DataFrame, sensors: Sequence[str] = REQUEST_SENSORS, carried: Sequence[str] = (), value: str = "value") -> DataFrame:
    """One row per request or reject of the JSON texts in ``value``.

    Columns: those ``carried`` from the lines, form (single, batch or NULL), at (place in the array, from 0), equipment_id,
    the sensors, ``extra`` (the carried field names as text, where the request has them), reason (NULL for a request),
    fields (what the reason is about) and element (the text of a reject).
    """
    text = F.trim(F.col(value), F.lit(" \t\r\n"))
    many = F.startswith(text, F.lit("["))
    rows = lines.filter(F.length(text) > 0).select(*carried, text.alias("_line"), F.when(many, "batch").otherwise("single").alias("form"))
    # A line that is no JSON is one reject; an empty array is no request and no reject.
    elements = F.when(F.col("form") == "batch", F.coalesce(F.from_json("_line", "array<string>", _PERMISSIVE), F.array("_line"))).otherwise(F.array("_line"))
    rows = rows.select(*carried, "form", F.posexplode(elements).alias("at", "element"))
    # A null among an array's elements is no object; only objects become maps.
    obj = F.when(F.startswith(F.trim("element"), F.lit("{")) & F.endswith(F.trim("element"), F.lit("}")), F.from_json("element", "map<string,string>", _PERMISSIVE))
    rows = rows.withColumn("_m", obj)
    given = {s: F.try_element_at("_m", F.lit(s)) for s in ("equipment_id", *sensors)}
    rows = rows.withColumns({f"_g{i}": c for i, c in enumerate(given.values())})
    texts = {s: F.col(f"_g{i}") for i, s in enumerate(given)}
    missing = [F.when(texts[s].isNull(), F.lit(s)) for s in sensors]
    missing = [F.when((F.col("form") == "batch") & texts["equipment_id"].isNull(), F.lit("equipment_id")), *missing]
    wrong = [F.when(texts[s].isNotNull() & _finite(texts[s]).isNull(), F.lit(s)) for s in sensors]
    there = lambda a: F.filter(F.array(*a), lambda x: x.isNotNull())
    rows = rows.withColumns({"_missing": there(missing), "_wrong": there(wrong)})
    reason = F.when(F.col("_m").isNull(), "malformed").when(F.size("_missing") > 0, "incomplete").when(F.size("_wrong") > 0, "wrong type")
    fields = F.when(F.col("_m").isNull(), F.lit("")).when(F.size("_missing") > 0, F.concat_ws(",", "_missing")).when(F.size("_wrong") > 0, F.concat_ws(",", "_wrong"))
    return rows.select(*carried, "form", "at", texts["equipment_id"].alias("equipment_id"), *[_finite(texts[s]).alias(s) for s in sensors],
                       F.col("_m").alias("extra"), reason.alias("reason"), fields.alias("fields"), F.when(reason.isNotNull(), F.col("element")).alias("element"))


def read_requests(spark: SparkSession, path: str, sensors: Sequence[str] = REQUEST_SENSORS) -> tuple[DataFrame, DataFrame]:
    """(requests, rejects) of the JSON files below ``path``; the single form's equipment is NULL (scored as ``unknown``, R06).

    The lines are read and parsed once, into a Parquet folder below the shared one, which both tables read: filters on
    parsed columns would otherwise parse every element again for each of their terms.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = parse_requests(lines, sensors, carried=["file"])
    folder = f"{ensure_checkpoint_dir(spark)}/parsed-requests-{uuid.uuid4().hex}"
    parsed.write.parquet(folder)
    rows = spark.read.schema(parsed.schema).parquet(folder)
    return (rows.filter(F.col("reason").isNull()).drop("reason", "fields", "element"),
            rows.filter(F.col("reason").isNotNull()).select("file", "form", "at", "equipment_id", "reason", "fields", "element", "extra"))
