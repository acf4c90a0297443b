"""SparkSession construction and shared-folder helpers.

Library code never builds its own session: every operator takes the caller's
DataFrames.  ``build_session`` is for tests, the bench and command-line jobs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  The session time zone is pinned to UTC because
# the parquet inputs store zone-less timestamps that we cast to TIMESTAMP.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Python call-site capture for error messages costs several JVM round trips
    # per Column call while plans are built; off for jobs and benches.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "vigil",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session for tests / bench / local jobs (cluster jobs use spark-submit's)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("VIGIL_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    if "spark.checkpoint.dir" not in conf and (master == "local" or (master or "").startswith("local[")):
        # Local runs only: a cluster names its shared folder itself.
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="vigil-ckpt-")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset, a scratch folder is
    taken on ``local`` masters (one machine) only; on a cluster that raises, since a folder of one
    machine is not shared.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vigil-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder and return the re-rooted frame.

    The frame is persisted first so the checkpoint write reads the computed
    rows instead of recomputing them; the cached copy is released afterwards.
    Checkpoint files survive executor loss (unlike ``localCheckpoint``).
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
