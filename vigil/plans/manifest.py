"""What a job has written: a rerun skips the steps whose inputs and settings are the same, and replaces the others.

A record is one small JSON file below ``out/_manifest/step``, written after the step's tables.  It names the step's outputs
and a fingerprint of its input files (name, size, time of change), its settings and the records of the steps it builds on, so a
step is done again when anything before it was.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vigil.sources.files import path_exists


def files_fingerprint(spark: SparkSession, paths: Mapping[str, str]) -> str:
    """A hash of the names, sizes and times of change of the files below the paths; contents are not read."""
    total = hashlib.sha256()
    for name, path in sorted(paths.items()):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.unix_micros("modificationTime").alias("t"))
        one = listed.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "length", "t")).alias("h"), F.sum("length").alias("b")).first()
        total.update(json.dumps([name, one["n"], one["h"], one["b"]]).encode())
    return total.hexdigest()


class Manifest:
    """The records of one output folder."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out, self.ran, self.skipped = spark, out.rstrip("/"), [], []

    def record(self, step: str) -> dict | None:
        path = f"{self.out}/_manifest/{step}"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0]) if path_exists(self.spark, f"{path}/_SUCCESS") else None

    def step(self, name: str, fingerprint: object, make: Callable[[], dict], after: tuple[str, ...] = ()) -> dict:
        """The facts that ``make`` returned when the step ran last with this fingerprint, or runs it now.

        ``make`` writes the step's tables and returns {"outputs": {name: path or None}, ...}; None stands for a table left unwritten.
        """
        before = [(self.record(s) or {}).get("mark") for s in after]
        mark = hashlib.sha256(json.dumps([fingerprint, before], sort_keys=True, default=str).encode()).hexdigest()
        known = self.record(name)
        if known and known["mark"] == mark and all(p is None or path_exists(self.spark, p) for p in known["facts"]["outputs"].values()):
            self.skipped.append(name)
            return known["facts"]
        facts = make()
        text = json.dumps({"mark": mark, "facts": facts}, default=str)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.out}/_manifest/{name}")
        self.ran.append(name)
        return facts
