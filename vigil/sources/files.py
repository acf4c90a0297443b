"""File sources and sinks.

Readers declare their schema (no inference pass over the data); every reader
returns canonical DataFrames.  Text timestamps are parsed strictly
(``to_timestamp``: a bad value fails the job under ANSI) or coercively
(``try_to_timestamp``: NULL), as the two reference paths do.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.sources.tables import normalize_ingest

# --- canonical schemas (S01) -------------------------------------------------
# fixed values (must equal the reference's): column names of the three canonical tables and of AI4I
SENSOR_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("equipment_id", T.StringType()),
    T.StructField("vibration", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("pressure", T.DoubleType()),
    T.StructField("current", T.DoubleType()),
    T.StructField("rpm", T.DoubleType()),
    T.StructField("degradation_level", T.DoubleType()),
    T.StructField("failure_imminent", T.BooleanType()),
])
MAINTENANCE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("equipment_id", T.StringType()),
    T.StructField("maintenance_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("parts_replaced", T.StringType()),
    T.StructField("technician", T.StringType()),
    T.StructField("downtime_hours", T.DoubleType()),
])
OPERATIONAL_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("equipment_id", T.StringType()),
    T.StructField("production_rate", T.DoubleType()),
    T.StructField("shift", T.StringType()),
    T.StructField("operator_id", T.StringType()),
    T.StructField("ambient_temperature", T.DoubleType()),
    T.StructField("ambient_humidity", T.DoubleType()),
    T.StructField("product_type", T.StringType()),
])
AI4I_SCHEMA = T.StructType([
    T.StructField("UDI", T.LongType()),
    T.StructField("Product ID", T.StringType()),
    T.StructField("Type", T.StringType()),
    T.StructField("Air temperature [K]", T.DoubleType()),
    T.StructField("Process temperature [K]", T.DoubleType()),
    T.StructField("Rotational speed [rpm]", T.LongType()),
    T.StructField("Torque [Nm]", T.DoubleType()),
    T.StructField("Tool wear [min]", T.LongType()),
    T.StructField("Machine failure", T.IntegerType()),
    T.StructField("TWF", T.IntegerType()),
    T.StructField("HDF", T.IntegerType()),
    T.StructField("PWF", T.IntegerType()),
    T.StructField("OSF", T.IntegerType()),
    T.StructField("RNF", T.IntegerType()),
])
# fixed values (must equal the reference's): CMAPSS positional column names
CMAPSS_COLUMNS = (["unit", "cycle"] + [f"op_setting_{i}" for i in range(1, 4)]
                  + [f"sensor_{i}" for i in range(1, 22)])
SCORING_REQUEST_SCHEMA = T.StructType([
    T.StructField("equipment_id", T.StringType()),
    T.StructField("vibration", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("pressure", T.DoubleType()),
    T.StructField("current", T.DoubleType()),
    T.StructField("rpm", T.DoubleType()),
    T.StructField("tool_wear", T.DoubleType()),
])


class MissingSourceError(FileNotFoundError):
    """A required source path does not exist."""


def parse_timestamps(df: DataFrame, column: str = "timestamp", strict: bool = True,
                     fmt: str | None = None) -> DataFrame:
    """Text → TIMESTAMP; strict raises on bad values (ANSI), coercing gives NULL."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (T.TimestampType,)):
        return df
    if strict:
        parsed = F.to_timestamp(c, fmt) if fmt else F.to_timestamp(c)
    else:
        parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return df.withColumn(column, parsed)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Hadoop-FS existence check (works for local, HDFS and object stores)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def require_paths(spark: SparkSession, paths: Mapping[str, str]) -> None:
    """Fail fast when any source is missing."""
    missing = [f"{k}: {p}" for k, p in paths.items() if not path_exists(spark, p)]
    if missing:
        raise MissingSourceError("data file not found: " + ", ".join(missing))


def header_schema(spark: SparkSession, path: str, declared: T.StructType) -> T.StructType:
    """The declared fields in the order of the file's header; further columns are text.

    Spark matches a CSV schema by position, so the header row of the file decides the order here.
    Raises ``ValueError`` where a declared column is missing or a name is repeated.
    """
    names = spark.read.option("header", True).csv(path).columns  # reads the first line only
    fields = {f.name: f for f in declared}
    missing = [n for n in fields if n not in names]
    if missing or len(set(names)) < len(names):
        raise ValueError(f"{path}: columns missing {missing}, header {names}")
    return T.StructType([fields.get(n, T.StructField(n, T.StringType())) for n in names])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             timestamp: str | None = "timestamp", strict: bool = True) -> DataFrame:
    """Header CSV; declared columns are found by name, whatever their order; timestamps parsed; NaN → NULL."""
    rdr = spark.read.option("header", True)
    if schema is not None:
        # enforceSchema=false: a file of the folder with another header raises instead of shifting columns
        rdr = rdr.schema(header_schema(spark, path, schema)).option("enforceSchema", False)
    else:
        rdr = rdr.option("inferSchema", True)
    df = rdr.csv(path)
    if timestamp and timestamp in df.columns:
        df = parse_timestamps(df, timestamp, strict)
    return normalize_ingest(df)


@dataclass
class Dataset:
    """Three canonical tables (the reference's dataset dict)."""
    sensor: DataFrame
    maintenance: DataFrame | None = None
    operational: DataFrame | None = None


def load_all(spark: SparkSession, sensor_path: str, maintenance_path: str, operational_path: str,
             strict: bool = True) -> Dataset:
    """S01 + S04: the three canonical CSV tables."""
    require_paths(spark, {"raw_data": sensor_path, "maintenance_logs": maintenance_path,
                          "operational_data": operational_path})
    return Dataset(read_csv(spark, sensor_path, SENSOR_SCHEMA, strict=strict),
                   read_csv(spark, maintenance_path, MAINTENANCE_SCHEMA, strict=strict),
                   read_csv(spark, operational_path, OPERATIONAL_SCHEMA, strict=strict))


def read_cmapss(spark: SparkSession, path: str) -> DataFrame:
    """Headerless whitespace-separated text, positional names, per-field ``try_cast``."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    cols = []
    for i, name in enumerate(CMAPSS_COLUMNS):
        typ = "long" if name in ("unit", "cycle") else "double"
        cols.append(F.try_element_at(parts, F.lit(i + 1)).try_cast(typ).alias(name))
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(*cols)


def read_cmapss_rul(spark: SparkSession, path: str) -> DataFrame:
    """The RUL file (one number per line, in unit order) with its unit number."""
    txt = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    # Line order is the unit number: lines are counted per split (one row per split is ordered), then
    # numbered inside their split.
    lines = txt.select("value", F.monotonically_increasing_id().alias("_id")) \
        .withColumn("_split", F.shiftright("_id", 33))
    before = lines.groupBy("_split").agg(F.count(F.lit(1)).alias("_n")).select(
        "_split", (F.sum("_n").over(Window.orderBy("_split")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_split").orderBy("_id"))
    return lines.withColumn("_k", inside).join(before, "_split").select(
        (F.col("_before") + F.col("_k")).cast("long").alias("unit"), F.trim("value").try_cast("double").alias("rul"))


def read_ai4i(spark: SparkSession, path: str) -> DataFrame:
    """The raw AI4I CSV (names with spaces and brackets), columns by name."""
    return read_csv(spark, path, AI4I_SCHEMA, timestamp=None)


def read_scoring_requests(spark: SparkSession, path: str, mandatory: Sequence[str] | None = None,
                          reject: bool = True) -> DataFrame:
    """JSON readings (one record or an array per line); NULL mandatory field → reject."""
    df = spark.read.schema(SCORING_REQUEST_SCHEMA).json(path)
    good, bad = split_requests(df, mandatory)
    if reject and not bad.isEmpty():
        raise ValueError("scoring request with a missing mandatory field")
    return good if reject else df


def split_requests(requests: DataFrame, mandatory: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests to score, reject table with ``missing``: the names of the absent mandatory fields).

    The equipment id is not mandatory: the single form has none and is scored as ``unknown``.
    """
    fields = list(mandatory) if mandatory is not None else [f.name for f in SCORING_REQUEST_SCHEMA if f.name != "equipment_id"]
    names = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fields])
    marked = requests.withColumn("missing", F.filter(names, lambda x: x.isNotNull()))
    return marked.filter(F.size("missing") == 0).drop("missing"), marked.filter(F.size("missing") > 0)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), skip_empty: bool = False) -> bool:
    """Write a table; ``skip_empty`` leaves empty tables unwritten."""
    if skip_empty and df.isEmpty():
        return False
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return True


def write_ranges_json(ranges: DataFrame, path: str) -> None:
    """Ranges as one JSON object ``{sensor: {min, max, mean, std}}`` (a bounded, tiny table)."""
    obj = ranges.agg(F.map_from_entries(F.collect_list(F.struct(
        "sensor", F.struct("min", "max", "mean", "std")))).alias("m"))
    obj.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_ranges_json(spark: SparkSession, path: str) -> DataFrame:
    """The JSON map back to the long table ``(sensor, min, max, mean, std)``."""
    schema = "map<string, struct<min: double, max: double, mean: double, std: double>>"
    raw = spark.read.option("multiLine", True).text(path, wholetext=True)
    m = raw.select(F.from_json("value", schema).alias("m"))
    return m.select(F.explode("m").alias("sensor", "r")).select(
        "sensor", "r.min", "r.max", "r.mean", "r.std")


# --- S05: dataset registry ---------------------------------------------------

Loader = Callable[..., Dataset]
_REGISTRY: dict[str, tuple[Loader, str]] = {}


def register_dataset(name: str, description: str):
    def deco(fn: Loader) -> Loader:
        _REGISTRY[name] = (fn, description)
        return fn
    return deco


def list_datasets() -> dict[str, str]:
    return {k: v[1] for k, v in _REGISTRY.items()}


def load_dataset(name: str, spark: SparkSession, **kwargs) -> Dataset:
    """Look up a loader by name; unknown names raise ``ValueError``."""
    if name not in _REGISTRY:
        raise ValueError(f"unknown dataset {name!r}; available: {sorted(_REGISTRY)}")
    return _REGISTRY[name][0](spark, **kwargs)


@register_dataset("ai4i2020", "AI4I 2020 predictive maintenance CSV (local file)")
def _load_ai4i(spark: SparkSession, path: str) -> Dataset:
    from vigil.operators.normalize import ai4i_maintenance, normalize_ai4i
    raw = read_ai4i(spark, path)
    return Dataset(normalize_ai4i(raw), ai4i_maintenance(raw), None)


@register_dataset("nasa_turbofan", "NASA CMAPSS run-to-failure text files (train/test/RUL)")
def _load_cmapss(spark: SparkSession, train_path: str, test_path: str | None = None,
                 rul_path: str | None = None) -> Dataset:
    from vigil.operators.normalize import cmapss_maintenance, normalize_cmapss
    raw = read_cmapss(spark, train_path)
    ds = Dataset(normalize_cmapss(raw), cmapss_maintenance(raw), None)
    ds.test = read_cmapss(spark, test_path) if test_path else None  # type: ignore[attr-defined]
    ds.rul = read_cmapss_rul(spark, rul_path) if rul_path else None  # type: ignore[attr-defined]
    return ds


@register_dataset("csv", "three canonical CSV tables (sensor, maintenance, operational)")
def _load_csv(spark: SparkSession, sensor: str, maintenance: str, operational: str) -> Dataset:
    return load_all(spark, sensor, maintenance, operational)


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns missing from a frame become NULL."""
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
