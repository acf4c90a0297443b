"""S11 + S12 + A24 + M07: models stored as versions with the feature schema they were trained on.

``path/v=N`` holds the fitted pipeline, its scaler, and ``schema``: one row per feature with its place, mean and scale.  A
version exists once its ``done`` file is written, last, so a lost job leaves no half model; versions are never overwritten.
Requests are checked against the schema before they are scored.

``forest_nodes`` and ``walk_forest`` give a forest as a table of nodes and score rows by joins with it, so any engine that
reads the table can apply the model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators import ml
from vigil.sources.files import path_exists

SCHEMA = "place int, feature string, mean double, scale double"


class SchemaMismatch(ValueError):
    """Requests lack features that the model was trained on, or hold them as something other than numbers."""


class ModelStore:
    """Versions of one model below a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """The complete versions, ascending."""
        if not path_exists(self.spark, self.path):
            return []
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        listed = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
        names = [s.getPath().getName() for s in listed]
        found = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
        return sorted(v for v in found if path_exists(self.spark, f"{self.path}/v={v}/done"))

    def _started(self) -> int:
        n = 1
        while path_exists(self.spark, f"{self.path}/v={n}"):
            n += 1
        return n

    def save(self, model: ml.TrainedModel) -> int:
        """Writes the model as the next version and returns its number."""
        version = self._started()
        here = f"{self.path}/v={version}"
        model.save(f"{here}/model")
        rows = [(k, c, float(model.scaler.mean[c]), float(model.scaler.scale[c])) for k, c in enumerate(model.feature_columns)]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{here}/schema")
        self.spark.createDataFrame([(str(version),)], "value string").coalesce(1).write.text(f"{here}/done")
        return version

    def _version(self, version: int | None) -> int:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.path}: no version {version if version is not None else 'at all'}; there are {known}")
        return known[-1] if version is None else version

    def load(self, version: int | None = None) -> ml.TrainedModel:
        """A version, by default the latest."""
        return ml.TrainedModel.load(self.spark, f"{self.path}/v={self._version(version)}/model")

    def schema(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v={self._version(version)}/schema")

    def drift(self, frame: DataFrame, version: int | None = None, ignored: Sequence[str] = ("equipment_id",)) -> DataFrame:
        """(column, state) for each feature and each column of ``frame``: ok, missing, not a number, extra, or moved
        (there, but not in the trained order among the features)."""
        expected = [r["feature"] for r in self.schema(version).orderBy("place").collect()]
        types = {f.name: f.dataType for f in frame.schema}
        order = [c for c in frame.columns if c in expected]
        present = [c for c in expected if c in types]
        rows = []
        for c in expected:
            if c not in types:
                rows.append((c, "missing"))
            elif not isinstance(types[c], T.NumericType):
                rows.append((c, "not a number"))
            else:
                rows.append((c, "ok" if order.index(c) == present.index(c) else "moved"))
        rows += [(c, "extra") for c in frame.columns if c not in expected and c not in ignored]
        return self.spark.createDataFrame(rows, "column string, state string")

    def score_requests(self, requests: DataFrame, by: str | None = "equipment_id", version: int | None = None, strict: bool = True,
                       as_of: str | Column = "2024-01-01 00:00:00") -> DataFrame:
        """M07 with a stored version: features aggregated over the requests, checked against its schema and scored.

        ``strict`` raises ``SchemaMismatch`` where a feature is missing or is no number; else such features count as 0 (P11).
        """
        from vigil.operators.features import equipment_features
        feats = equipment_features(requests, by)
        bad = [r for r in self.drift(feats, version, ignored=(by,) if by else ()).collect() if r["state"] in ("missing", "not a number")]
        if bad and strict:
            raise SchemaMismatch(", ".join(f"{r['column']}: {r['state']}" for r in bad))
        model = self.load(version)
        zero = {r["column"]: F.lit(0.0) for r in bad}
        return ml.prediction_result(ml.predict(model, feats.withColumns(zero) if zero else feats), "prediction", as_of=as_of, id_col=by or "equipment_id")


def forest_nodes(model: ml.TrainedModel) -> DataFrame:
    """(tree, node, feature, threshold, left, right, value) of every node of a fitted forest; leaves have feature -1.

    A row goes left where its standardised feature is at most the threshold.
    """
    forest = model.model.stages[-1]
    spark = SparkSession.getActiveSession()
    rows = []
    for tree, fitted in enumerate(forest.trees):  # the size of the model, not of the data
        node, stack = 0, [(fitted._java_obj.rootNode(), 0)]
        while stack:
            java, number = stack.pop()
            if java.subtreeDepth() == 0:
                rows.append((tree, number, -1, None, None, None, float(java.prediction())))
                continue
            split = java.split()
            rows.append((tree, number, int(split.featureIndex()), float(split.threshold()), node + 1, node + 2, float(java.prediction())))
            stack += [(java.leftChild(), node + 1), (java.rightChild(), node + 2)]
            node += 2
    return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, value double")


def walk_forest(model: ml.TrainedModel, nodes: DataFrame, df: DataFrame, key: str, out: str = "walked") -> DataFrame:
    """(key, out): the mean over all trees of the leaf that each row of ``df`` reaches, by one join with the nodes per level.

    The nodes are as many as the model has, whatever the data; the optimizer broadcasts them.
    """
    scaled = ml.apply_scaler(ml.zero_fill(df, model.feature_columns), model.scaler)
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in model.feature_columns])
    last = len(model.model.stages[-1].trees) - 1
    at = scaled.select(F.col(key), x.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("tree"), F.lit(0).alias("node"))
    for _ in range(max(t.depth for t in model.model.stages[-1].trees)):
        step = at.join(nodes, ["tree", "node"])
        goes = F.when(F.col("feature") < 0, F.col("node")).when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = step.select(key, "x", "tree", goes.alias("node"))
    return at.join(nodes, ["tree", "node"]).groupBy(key).agg(F.avg("value").alias(out))


def boost(train: DataFrame, held: DataFrame, features: Sequence[str], label: str = "rul", iterations: int = ml.GBT_ITERATIONS,
          depth: int = ml.GBT_DEPTH, by: str = "equipment_id") -> tuple[ml.TrainedModel, DataFrame]:
    """Gradient boosting on ``train``, and (iteration, train_loss, held_loss): the mean squared error after each tree."""
    estimator = ml.gbt(label=label).setMaxIter(iterations).setMaxDepth(depth)
    model = ml.train(train, features, label, estimator, by)
    losses = {}
    for name, side in (("train_loss", train), ("held_loss", held)):
        scaled = ml.apply_scaler(ml.zero_fill(side, list(features)), model.scaler, suffix="__s")
        vectors = model.model.stages[0].transform(scaled)
        losses[name] = model.model.stages[-1].evaluateEachIteration(vectors, "squared")
    rows = [(k + 1, float(a), float(b)) for k, (a, b) in enumerate(zip(losses["train_loss"], losses["held_loss"]))]
    return model, train.sparkSession.createDataFrame(rows, "iteration int, train_loss double, held_loss double")
