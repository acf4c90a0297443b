"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows may be broadcast; the callers take another way beyond it.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a scratch folder is taken on ``local[...]`` masters only; any other master raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = spark.conf.get("vigil.llm.scratch", None)
    if not path:
        path = tempfile.mkdtemp(prefix="vigil-llm-")
        spark.conf.set("vigil.llm.scratch", path)
    return path


#: Rows of text that cross to Python at once; a session may ask for fewer.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH_ROWS`` rows: whole texts are wide."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > BATCH_ROWS or int(conf.get(key)) <= 0:
        conf.set(key, str(BATCH_ROWS))
    return df


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = path or new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run wrote to the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def column(name: str) -> Column:
    """A top-level column, whatever signs its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; reads little more than that many."""
    return df.limit(rows + 1).count() <= rows


#: Ids to drop are broadcast while there are at most so many (some 100 MB as a hash table); beyond, they are joined.
DROP_ROWS = 2_000_000


def without(rows: DataFrame, drop: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without those whose ``keys`` (NULL equal to NULL) are among ``drop``; texts move only where ``drop`` is large."""
    names = [fresh(rows, f"_drop{n}") for n in range(len(keys))]
    drop = drop.select(*[column(k).alias(n) for n, k in zip(names, keys)]).distinct()
    same = F.lit(True)
    for n, k in zip(names, keys):
        same = same & column(k).eqNullSafe(F.col(n))
    return rows.join(F.broadcast(drop) if at_most(drop, DROP_ROWS) else drop, same, "left_anti")


def flagged(rows: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether ``key`` is in the one column of ``ids``; wide rows move only where ``ids`` is large."""
    name = fresh(rows, "_flagged")
    ids = ids.select(column(ids.columns[0]).alias(name)).filter(F.col(name).isNotNull()).distinct()
    side = F.broadcast(ids) if at_most(ids, DROP_ROWS) else ids
    return rows.join(side, column(key) == F.col(name), "left").withColumn(flag, F.col(name).isNotNull()).drop(name)


def join_side(left: DataFrame, side: DataFrame, key: str | list[str], how: str = "left", salts: int = 64) -> DataFrame:
    """Join ``left`` to ``side`` (unique in ``key``, never NULL there) without a hot partition.

    A side of at most ``BROADCAST_ROWS`` rows is broadcast.  A larger one is copied to ``salts`` salts and
    the left rows are dealt over them, so that a key with a third of all rows meets ``salts`` tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if at_most(side, BROADCAST_ROWS):
        return left.join(F.broadcast(side), keys, how)
    salted = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
