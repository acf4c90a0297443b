"""Model preparation, training, metrics and scoring.

Training uses MLlib's ``RandomForestRegressor`` (distributed tree induction);
the scaler is fitted with one aggregate (mean and *population* std, zero std →
scale 1, as the reference's scaler does — MLlib's ``StandardScaler`` uses the
sample std and maps zero variance to 0, so it is not used).  Scoring is a
``transform`` plus the rule expressions of ``functions.rules``, so the same
function scores a batch table or a stream.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import rules as R
from vigil.operators.features import numeric_columns

# fixed values (must equal the reference's)
FOREST_TREES = 100
FOREST_DEPTH = 10
FOREST_SEED = 42
SIMPLE_FOREST_TREES = 50
MOST_DEPTH = 30
GBT_ITERATIONS = 100
GBT_DEPTH = 6
GBT_STEP = 0.1
ENSEMBLE_WEIGHTS = (0.35, 0.30, 0.25, 0.10)
TEMPLATE_SENSORS = ("vibration", "temperature", "pressure", "current", "rpm", "tool_wear")
TEMPLATE_VALUE_TERMS = ("mean", "max", "min", "median")
TEMPLATE_SPREAD_TERMS = ("std", "range")
TEMPLATE_SPREAD_VALUE = 0.1
BASIC_VECTOR_WIDTH = 50
ROUND_RUL, ROUND_PROB, ROUND_CONF = 2, 4, 4


def zero_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL → 0 on numeric columns."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    return df.fillna(0, subset=cols)


def prepare_xy(features: DataFrame, labels: DataFrame | None = None, by: str = "equipment_id",
               target: str = "rul") -> tuple[DataFrame, list[str]]:
    """M01 + J03 + P09: join features to labels by id, numeric X with NULL → 0, y = ``target``."""
    df = features if labels is None else features.join(labels.select(by, target), by, "inner")
    if target not in df.columns:
        raise ValueError(f"no {target!r} column to train on")
    xcols = [c for c in numeric_columns(df, exclude=[by, target, "failure_probability"])]
    return zero_fill(df, xcols), xcols


@dataclass
class ScalerParams:
    """Column → (mean, scale)."""
    columns: list[str]
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    rows: int | None = None

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "mean": self.mean, "scale": self.scale})

    @staticmethod
    def from_json(text: str) -> "ScalerParams":
        d = json.loads(text)
        return ScalerParams(d["columns"], d["mean"], d["scale"])


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> ScalerParams:
    """One aggregate; population std; zero or undefined std → 1 (also counts the rows)."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    p = ScalerParams(list(columns))
    p.rows = row["_rows"]
    for i, c in enumerate(columns):
        m, s = row[f"m{i}"], row[f"s{i}"]
        p.mean[c] = 0.0 if m is None else m
        p.scale[c] = 1.0 if (s is None or s == 0.0) else s
    return p


def apply_scaler(df: DataFrame, params: ScalerParams, suffix: str = "") -> DataFrame:
    """(x - mean) / scale with the fitted literals (works on streams)."""
    return df.withColumns({
        f"{c}{suffix}": (F.col(f"`{c}`").cast("double") - F.lit(params.mean[c])) / F.lit(params.scale[c])
        for c in params.columns})


def forest(n_trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, seed: int = FOREST_SEED,
           features_col: str = "features", label: str = "rul") -> RandomForestRegressor:
    """Forest with every feature considered at each split; MLlib trees are at most 30 deep."""
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth {depth}: trees have 0 to {MOST_DEPTH} levels")
    return RandomForestRegressor(featuresCol=features_col, labelCol=label, numTrees=n_trees,
                                 maxDepth=depth, featureSubsetStrategy="all", seed=seed)


def gbt(features_col: str = "features", label: str = "rul") -> GBTRegressor:
    """Gradient boosting 100 x depth 6 x 0.1."""
    return GBTRegressor(featuresCol=features_col, labelCol=label, maxIter=GBT_ITERATIONS,
                        maxDepth=GBT_DEPTH, stepSize=GBT_STEP, seed=FOREST_SEED)


@dataclass
class TrainedModel:
    """M04 result: scaler literals + fitted pipeline + feature list."""
    scaler: ScalerParams
    model: PipelineModel
    feature_columns: list[str]
    label: str = "rul"

    def save(self, path: str) -> None:
        """S11 + S12: pipeline via MLWriter, scaler and feature schema as JSON beside it."""
        self.model.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        meta = {"scaler": json.loads(self.scaler.to_json()), "feature_columns": self.feature_columns,
                "feature_count": len(self.feature_columns), "label": self.label}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TrainedModel":
        model = PipelineModel.load(f"{path}/pipeline")
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        sc = meta["scaler"]
        return TrainedModel(ScalerParams(sc["columns"], sc["mean"], sc["scale"]), model,
                            meta["feature_columns"], meta.get("label", "rul"))


TRAIN_PARTITIONS = 16


def train(df: DataFrame, feature_cols: Sequence[str], label: str = "rul",
          estimator=None, by: str = "equipment_id", partitions: int = TRAIN_PARTITIONS) -> TrainedModel:
    """Fit the scaler on ``df`` (the training rows) and the forest on the scaled vector.

    Bagging draws per partition and in row order, so the rows are dealt by a hash of ``by`` (of all
    features where that column is absent) over a fixed number of ``partitions`` and sorted inside them: the
    model does not depend on how the rows arrive.  Raise ``partitions`` with the cluster.
    """
    params = fit_scaler(df, feature_cols)
    scaled = apply_scaler(df, params, suffix="__s")
    keys = [by] if by in df.columns else list(feature_cols)
    scaled = scaled.repartition(partitions, *[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(
        *[F.col(f"`{k}`") for k in keys], F.xxhash64(*[F.col(f"`{c}__s`") for c in feature_cols], F.col(label)))
    asm = VectorAssembler(inputCols=[f"{c}__s" for c in feature_cols], outputCol="features",
                          handleInvalid="keep")
    est = estimator or forest(label=label)
    model = Pipeline(stages=[asm, est]).fit(scaled)
    return TrainedModel(params, model, list(feature_cols), label)


def predict(tm: TrainedModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Raw model output for every row (M06 scores all rows, not row 0)."""
    scaled = apply_scaler(zero_fill(df, [c for c in tm.feature_columns if c in df.columns]),
                          tm.scaler, suffix="__s")
    res = tm.model.transform(scaled)
    drop = [f"{c}__s" for c in tm.feature_columns] + ["features"]
    return res.withColumnRenamed("prediction", out).drop(*drop)


def regression_metrics(df: DataFrame, label: str = "rul", pred: str = "prediction") -> DataFrame:
    """A19 + A20: MAE, RMSE, R² in one aggregate (R² NULL for a constant label)."""
    err = F.col(pred) - F.col(label)
    sst = F.var_pop(label) * F.count(F.col(label))
    return df.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(F.pow(err, 2))).alias("rmse"),
                  (F.lit(1.0) - F.try_divide(F.sum(F.pow(err, 2)), sst)).alias("r2"))


def prediction_result(df: DataFrame, rul: str = "prediction", as_of: str | Column = "2024-01-01 00:00:00",
                      id_col: str = "equipment_id", clamp: bool = True, risk: str = "reference") -> DataFrame:
    """M06 + R01–R06 + P14: the scored result row (keeps every input column, P15)."""
    r = R.clamp_rul(rul, clamp)
    p = R.probability_from_rul(r, risk)
    ts = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    eid = R.default_equipment_id(id_col) if id_col in df.columns else F.lit("unknown")
    return df.withColumns({
        id_col: eid,
        "predicted_rul_hours": F.round(r, ROUND_RUL),
        "failure_probability": F.round(p, ROUND_PROB),
        "confidence": F.round(R.confidence(r), ROUND_CONF),
        "maintenance_recommendation": R.recommendation(r, p),
        "predicted_failure_date": R.failure_date(r, ts),
        "prediction_timestamp": ts,
    })


def score_request_aggregate(tm: "TrainedModel", requests: DataFrame, by: str | None = "equipment_id",
                            as_of: str | Column = "2024-01-01 00:00:00") -> DataFrame:
    """Features aggregated over the incoming request rows (per equipment, or
    the whole batch when ``by`` is None), aligned to the training features and scored."""
    from vigil.operators.features import equipment_features
    feats = equipment_features(requests, by)
    missing = [c for c in tm.feature_columns if c not in feats.columns]
    feats = feats.withColumns({c: F.lit(0.0) for c in missing}) if missing else feats
    res = prediction_result(predict(tm, feats), "prediction", as_of=as_of,
                            id_col=by or "equipment_id")
    return res


def weighted_ensemble(columns: Sequence[str], weights: Sequence[float] = ENSEMBLE_WEIGHTS) -> Column:
    """Σ wᵢ·pᵢ / Σ wᵢ (weights by position); raises unless there is one weight per column."""
    if len(columns) != len(weights):
        raise ValueError(f"{len(columns)} columns, {len(weights)} weights")
    num = None
    den = 0.0
    for c, w in zip(columns, weights):
        term = F.lit(w) * F.col(c).cast("double")
        num = term if num is None else num + term
        den = den + w
    return num / F.lit(den)


def align_to_template(df: DataFrame, feature_columns: Sequence[str], keep: Sequence[str] = (),
                      sensors: Sequence[str] = TEMPLATE_SENSORS, match: str = "contains") -> DataFrame:
    """One column per template feature, in template order.

    Start from 0.0; for each sensor present (in order; the last one wins), every
    feature whose name contains the sensor name (``match='prefix'``: starts
    with ``sensor_``) gets the reading (names with mean/max/min/median, or any
    other), or 0.1 for std/range names.  A NULL reading counts as 0.
    """
    exprs = []
    present = [s for s in sensors if s in df.columns]
    for feat in feature_columns:
        val: Column = F.lit(0.0)
        for s in present:
            hit = feat.startswith(f"{s}_") if match == "prefix" else s in feat
            if not hit:
                continue
            reading = F.coalesce(F.col(s).cast("double"), F.lit(0.0))
            if any(t in feat for t in TEMPLATE_VALUE_TERMS):
                val = reading
            elif any(t in feat for t in TEMPLATE_SPREAD_TERMS):
                val = F.lit(TEMPLATE_SPREAD_VALUE)
            else:
                val = reading
        exprs.append(val.alias(feat))
    return df.select(*keep, *exprs)


def basic_vector(df: DataFrame, keep: Sequence[str] = (), sensors: Sequence[str] = TEMPLATE_SENSORS,
                 width: int = BASIC_VECTOR_WIDTH) -> DataFrame:
    """Sensor, _mean, _max, _min per present sensor, then ``feature_i`` zeros up to ``width``."""
    exprs = []
    for s in sensors:
        if s in df.columns:
            v = F.coalesce(F.col(s).cast("double"), F.lit(0.0))
            exprs += [v.alias(s), v.alias(f"{s}_mean"), v.alias(f"{s}_max"), v.alias(f"{s}_min")]
    for i in range(len(exprs), width):
        exprs.append(F.lit(0.0).alias(f"feature_{i}"))
    return df.select(*keep, *exprs)


def template_frame(spark: SparkSession, feature_columns: Sequence[str]) -> DataFrame:
    """The one-row zero template with the training feature order."""
    return spark.range(1).select(*[F.lit(0.0).alias(c) for c in feature_columns])


def feature_importance_view(corr_long: DataFrame, target: str = "failure_probability") -> DataFrame:
    """The correlation-matrix row of the target."""
    return corr_long.filter(F.col("sensor_a") == target).select(
        F.col("sensor_b").alias("feature"), F.col("corr").alias("importance"))


__all__ = ["zero_fill", "prepare_xy", "fit_scaler", "apply_scaler", "forest", "gbt", "train",
           "predict", "regression_metrics", "prediction_result", "weighted_ensemble",
           "align_to_template", "basic_vector", "template_frame", "TrainedModel", "ScalerParams"]
