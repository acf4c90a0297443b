"""Whole jobs (E01–E09) as composed DataFrame transforms, plus a spark-submit entry.

    zip -r vigil.zip vigil
    spark-submit --py-files vigil.zip vigil/plans/jobs.py train \
        --sensor s.csv --maintenance m.csv --operational o.csv --out /shared/models/run1
    spark-submit --py-files vigil.zip vigil/plans/jobs.py dataset --name ai4i2020 \
        --path path=/shared/raw/ai4i2020.csv --out /shared/runs/ai4i

Further commands: ``features``, ``retrain``, ``simple``, ``fleet`` and ``profile`` (E06–E09); tables are Parquet folders, or CSV
files with a header where the path ends in ``.csv``.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import clean, features, fleet, ml, profile, quality, series, split
from vigil.operators.ordered import suggest_bucket_seconds
from vigil.plans.manifest import Manifest, files_fingerprint
from vigil.session import cut_lineage
from vigil.sources import files


@dataclass
class JobConfig:
    """Job parameters (the reference's YAML, reduced to what is computed)."""
    missing_method: str = "interpolate"
    interpolate_scope: str | None = "equipment_id"   # None: table-wide, as the reference
    zscore_threshold: float = clean.ZSCORE_THRESHOLD
    test_fraction: float = split.TEST_FRACTION
    seed: int = split.SPLIT_SEED
    trees: int = ml.FOREST_TREES
    depth: int = ml.FOREST_DEPTH
    range_sigmas: float = quality.RANGE_SIGMAS
    tiebreak: tuple[str, ...] = ()
    operational_tiebreak: tuple[str, ...] = ()
    bucket_seconds: int | None = None          # None: derived from the densest equipment
    bucket_target_rows: int = 2_000_000


@dataclass
class TrainResult:
    model: ml.TrainedModel
    metrics: dict = field(default_factory=dict)
    features: DataFrame | None = None
    labels: DataFrame | None = None


def features_and_labels(cleaned: DataFrame, order=("timestamp",)) -> tuple[DataFrame, DataFrame]:
    """A01 features + A03 labels per equipment."""
    feats = features.equipment_features(cleaned, "equipment_id")
    labels = features.equipment_labels(cleaned, "equipment_id", list(order))
    return feats, labels


def train_and_validate(feats: DataFrame, labels: DataFrame, cfg: JobConfig, stratify: bool = False) -> TrainResult:
    """Join, split once (``stratify``: by the first stratum column of the labels), fit on train, report
    held-out MAE / RMSE / R²."""
    stratum = split.pick_stratum(labels) if stratify else None
    data, xcols = ml.prepare_xy(feats, labels, "equipment_id", "rul")
    if stratum and stratum not in data.columns:
        data = data.join(labels.select("equipment_id", stratum), "equipment_id")
        xcols = [c for c in xcols if c != stratum]
    data = split.split(data, "equipment_id", strata=stratum, test_fraction=cfg.test_fraction, seed=cfg.seed)
    data = data.persist()
    tm = ml.train(data.filter(F.col("split") == "train"), xcols, "rul",
                  ml.forest(cfg.trees, cfg.depth, cfg.seed))
    held = ml.predict(tm, data.filter(F.col("split") == "test"))
    m = ml.regression_metrics(held, "rul", "prediction").first().asDict()
    data.unpersist()
    return TrainResult(tm, m, feats, labels)


def train_job(spark: SparkSession, ds: files.Dataset, out: str | None, cfg: JobConfig = JobConfig(),
              stratify: bool = False) -> TrainResult:
    """Load → E02 clean → E03 features/labels → M04 train → M05 validate → S11 save."""
    width = cfg.bucket_seconds or suggest_bucket_seconds(
        ds.sensor, cfg.interpolate_scope or [], "timestamp", cfg.bucket_target_rows)
    cleaned = clean.clean_and_preprocess(
        ds.sensor, ds.operational, cfg.missing_method, tiebreak=list(cfg.tiebreak),
        operational_tiebreak=list(cfg.operational_tiebreak), interpolate_by=cfg.interpolate_scope,
        bucket_seconds=width, zscore_threshold=cfg.zscore_threshold)
    # E02's sink: features, labels and training read the cleaned table back instead of cleaning it again
    if out:
        files.write_table(cleaned, f"{out}/cleaned")
        cleaned = spark.read.parquet(f"{out}/cleaned")
    else:
        cleaned = cut_lineage(cleaned)
    order = ["timestamp", *cfg.tiebreak]
    feats, labels = features_and_labels(cleaned, order)
    res = train_and_validate(feats, labels, cfg, stratify)
    if out:
        res.model.save(f"{out}/model")
        files.write_table(feats, f"{out}/features")
        files.write_table(labels, f"{out}/labels")
    return res


def dataset_job(spark: SparkSession, name: str, out: str, cfg: JobConfig = JobConfig(), **paths) -> dict:
    """Registry load → raw copies → E04 → ranges on raw sensor data → profile, as steps of a manifest.

    S04: every named file must be there.  S13: an empty maintenance or operational table is left unwritten.  A rerun skips
    the steps whose inputs and settings have not changed (``ran`` and ``skipped`` in the result).
    """
    files.require_paths(spark, {k: v for k, v in paths.items() if v is not None})
    manifest = Manifest(spark, out)
    ds = files.load_dataset(name, spark, **paths)

    def raw() -> dict:
        made = {"sensor": f"{out}/raw/sensor"}
        files.write_table(ds.sensor, made["sensor"])
        for part, table in (("maintenance", ds.maintenance), ("operational", ds.operational)):
            wrote = table is not None and files.write_table(table, f"{out}/raw/{part}", skip_empty=True)
            made[part] = f"{out}/raw/{part}" if wrote else None
        return {"outputs": made}

    facts = manifest.step("raw", [name, files_fingerprint(spark, {k: v for k, v in paths.items() if v is not None})], raw)
    read = {k: spark.read.parquet(p) if p else None for k, p in facts["outputs"].items()}
    stored = files.Dataset(read["sensor"], read["maintenance"], read["operational"])

    def train() -> dict:
        res = train_job(spark, stored, out, cfg, stratify=True)
        return {"outputs": {k: f"{out}/{k}" for k in ("cleaned", "features", "labels", "model/meta")}, "metrics": res.metrics}

    def ranges() -> dict:
        files.write_ranges_json(quality.expected_ranges(stored.sensor, n_sigma=cfg.range_sigmas), f"{out}/expected_ranges")
        return {"outputs": {"expected_ranges": f"{out}/expected_ranges"}}

    def describe() -> dict:
        made = {}
        for part, table in profile_job(stored.sensor).items():
            made[part] = f"{out}/profile/{part}"
            files.write_table(table, made[part])
        prof = profile.dataset_profile(stored.sensor).first().asDict()
        return {"outputs": made, "profile": {k: str(v) for k, v in prof.items()}}

    metrics = manifest.step("train", asdict(cfg), train, after=("raw",))["metrics"]
    manifest.step("ranges", cfg.range_sigmas, ranges, after=("raw",))
    prof = manifest.step("profile", None, describe, after=("raw",))["profile"]
    return {"metrics": metrics, "profile": prof, "ran": manifest.ran, "skipped": manifest.skipped}


def features_job(spark: SparkSession, sensor_path: str, out: str, order: tuple[str, ...] = ("timestamp",)) -> dict[str, DataFrame]:
    """E07, feature half: features and labels from a stored sensor table (CSV by header name, or Parquet), no training."""
    sensor = files.read_csv(spark, sensor_path, files.SENSOR_SCHEMA) if sensor_path.endswith(".csv") else spark.read.parquet(sensor_path)
    feats, labels = features_and_labels(sensor, order)
    files.write_table(feats, f"{out}/features")
    files.write_table(labels, f"{out}/labels")
    return {"features": feats, "labels": labels}


def simple_job(spark: SparkSession, readings: DataFrame, out: str | None = None,
               tiebreak: tuple[str, ...] = (), trees: int = ml.SIMPLE_FOREST_TREES, depth: int = ml.MOST_DEPTH) -> dict:
    """Simple features → split → scaler → forest → R² on train and test."""
    width = suggest_bucket_seconds(readings, "equipment_id", "timestamp")
    sf = features.simple_features(readings, "equipment_id", "timestamp", list(tiebreak), width)
    data, xcols = ml.prepare_xy(sf, None, "equipment_id", "rul")
    data = split.split(data, "equipment_id").persist()
    tm = ml.train(data.filter(F.col("split") == "train"), xcols, "rul",
                  ml.forest(trees, depth))
    pred = ml.predict(tm, data)
    r2 = {s: ml.regression_metrics(pred.filter(F.col("split") == s)).first()["r2"]
          for s in ("train", "test")}
    if out:
        tm.save(f"{out}/simple_model")
    data.unpersist()
    return {"r2": r2}


def retrain_job(spark: SparkSession, features_path: str, labels_path: str, out: str | None,
                cfg: JobConfig = JobConfig()) -> TrainResult:
    """Retrain from stored feature and label tables (parquet or CSV with header)."""
    def load(p: str) -> DataFrame:
        if p.endswith(".csv"):
            return files.read_csv(spark, p, timestamp=None)
        return spark.read.parquet(p)
    res = train_and_validate(load(features_path), load(labels_path), cfg)
    if out:
        res.model.save(f"{out}/model")
    return res


def fleet_report(scored: DataFrame, out: str | None = None) -> dict[str, DataFrame]:
    """Every report of the batch page.

    Tiers, risk matrix, histogram and summary come from one grouping-sets
    aggregate (one scan); its few dozen result rows are cut from the lineage so
    the four reports do not recompute it.  The correlation matrix is a second
    pass.  The scored table itself is never cached.
    """
    agg = cut_lineage(fleet.fleet_aggregates(scored))
    rep = fleet.reports_from_aggregates(agg)
    rep["correlations"] = series.corr_matrix(scored, [c for c in (
        "vibration", "temperature", "pressure", "current", "rpm", "tool_wear", "failure_probability")
        if c in scored.columns])
    if out:
        files.write_table(scored, f"{out}/batch_analysis_results", fmt="csv")
        for k, v in rep.items():
            files.write_table(v, f"{out}/{k}")
    return rep


def profile_job(sensor: DataFrame) -> dict[str, DataFrame]:
    """Profile, failure rates, distributions of text failure columns, numeric summary."""
    out = {"profile": profile.dataset_profile(sensor),
           "failure_rates": profile.failure_rates(sensor),
           "numeric_summary": profile.numeric_summary(sensor)}
    for c in profile.failure_columns(sensor):
        if sensor.schema[c].dataType.simpleString() == "string":
            out[f"distribution_{c}"] = profile.value_distribution(sensor, c)
    return out


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="vigil")
    sub = ap.add_subparsers(dest="cmd", required=True)

    def command(name: str, *needed: str, **optional) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        for n, default in optional.items():
            p.add_argument(f"--{n}", default=default)
        return p

    command("train", "sensor", "maintenance", "operational", "out")
    d = command("dataset", "out")
    d.add_argument("--name", required=True, choices=sorted(files.list_datasets()))
    d.add_argument("--path", action="append", default=[], help="key=value loader arguments")
    command("features", "sensor", "out")
    command("retrain", "features", "labels", "out")
    command("simple", "sensor", "out")
    command("fleet", "readings", "out")
    command("profile", "sensor", "out")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("vigil").getOrCreate()

    def readings(path: str) -> DataFrame:
        return files.read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)

    result: dict = {}
    if args.cmd == "train":
        result = train_job(spark, files.load_all(spark, args.sensor, args.maintenance, args.operational), args.out).metrics
    elif args.cmd == "dataset":
        result = dataset_job(spark, args.name, args.out, **dict(p.split("=", 1) for p in args.path))
    elif args.cmd == "features":
        features_job(spark, args.sensor, args.out)
    elif args.cmd == "retrain":
        result = retrain_job(spark, args.features, args.labels, args.out).metrics
    elif args.cmd == "simple":
        result = simple_job(spark, readings(args.sensor), args.out)
    elif args.cmd == "fleet":
        fleet_report(fleet.score_batch(readings(args.readings)), args.out)
    elif args.cmd == "profile":
        for name, table in profile_job(readings(args.sensor)).items():
            files.write_table(table, f"{args.out}/{name}")
    print(json.dumps(result, default=str))


if __name__ == "__main__":
    main()
