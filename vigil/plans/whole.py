"""Registered queries that go through files, stored models and whole jobs, and check what they leave behind.

Trained models have no SQL form; those queries return facts about them (row counts, equality of two ways to score, falling
losses), which the SQL states from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigil.operators import features, fleet, ml, model_store, normalize, split
from vigil.operators.asof import asof_join
from vigil.plans import jobs
from vigil.plans.readings import EVENT_SENSORS, event_readings
from vigil.plans.util import finish
from vigil.session import cut_lineage, ensure_checkpoint_dir
from vigil.sources import files, requests
from vigil.sources.tables import read_table
from vigil.streaming import jobs as streaming

_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
#: Trees of the models that these queries train for their facts (rf_train_score trains the full ones).
TREES, DEPTH, ROUNDS = 8, 4, 12


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _facts(spark, **facts):
    """One row (fact, value) per fact."""
    return spark.createDataFrame([(k, int(v)) for k, v in facts.items()], "fact string, value long")


# --- S09: request files -------------------------------------------------------------

def q_request_files(spark, sf_dir):
    """S09 + R06: readings written as JSON requests, single and in arrays, some cut short, incomplete or of a wrong type, and read back."""
    rd = event_readings(spark, sf_dir, with_degradation=False, gaps=True)
    e = F.col("event_id")
    one = F.to_json(F.struct("event_id", F.when((e % 7 != 0) | (e % 3 == 0) & (e % 21 != 0), F.col("equipment_id")).alias("equipment_id"),
                             *[F.col(s) for s in EVENT_SENSORS if s != "rpm"],
                             F.when(e % 13 == 0, F.lit("fast")).otherwise(F.col("rpm").cast("string")).alias("rpm")))
    rows = rd.select("event_id", F.expr("event_id div 30").alias("grp"), one.alias("json"))
    single = rows.filter("event_id % 3 <> 0").select(F.when(e % 11 == 0, F.substring("json", F.lit(1), F.length("json") - 5)).otherwise(F.col("json")).alias("value"))
    many = rows.filter("event_id % 3 = 0").groupBy("grp").agg(F.array_sort(F.collect_list("json")).alias("js"))
    text = F.concat(F.lit("[ "), F.array_join("js", ", "), F.when(F.col("grp") % 17 == 0, F.lit("")).otherwise(F.lit(" ]")))
    path = _folder(spark, "requests")
    single.unionByName(many.select(text.alias("value"))).write.text(path)
    good, bad = requests.read_requests(spark, path)
    from vigil.functions.rules import default_equipment_id
    event = F.try_element_at("extra", F.lit("event_id")).cast("long").alias("event_id")
    cols = ["form", "event_id", "equipment_id", "temperature", "reason", "fields", "n"]
    one = F.lit(1).cast("long").alias("n")
    ok = good.select("form", event, default_equipment_id("equipment_id").alias("equipment_id"), "temperature", F.lit("").alias("reason"), F.lit("").alias("fields"), one)
    none = F.lit(None).cast("double").alias("temperature")
    known = bad.filter("reason <> 'malformed'").select("form", event, default_equipment_id("equipment_id").alias("equipment_id"), none, "reason", "fields", one)
    broken = bad.filter("reason = 'malformed'").groupBy("form").agg(F.count(F.lit(1)).alias("n")).select(
        "form", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("equipment_id"), none, F.lit("malformed").alias("reason"), F.lit("").alias("fields"), "n")
    return finish(ok.unionByName(known).unionByName(broken).select(*cols))


# --- stored models --------------------------------------------------------------------

def _training(spark, sf_dir):
    """Features (A01) and labels (A03) per equipment, cut from the lineage."""
    rd = event_readings(spark, sf_dir, with_degradation=False).withColumn("degradation_level", F.col("tool_wear") / 300.0)
    feats = features.equipment_features(rd, "equipment_id", EVENT_SENSORS)
    labels = features.equipment_labels(rd, "equipment_id", ["timestamp", "event_id"])
    data, xcols = ml.prepare_xy(feats, labels, "equipment_id", "rul")
    return rd, cut_lineage(data), xcols


def q_stored_model(spark, sf_dir):
    """S11 + S12 + A24 + M07: two versions of a model are stored; requests scored with the first one loaded, after a check of their features."""
    rd, data, xcols = _training(spark, sf_dir)
    store = model_store.ModelStore(spark, _folder(spark, "models"))
    first = ml.train(data, xcols, "rul", ml.forest(TREES, DEPTH))
    store.save(first)
    store.save(ml.train(data, xcols[:6], "rul", ml.forest(2, 2)))
    asked = rd.select("equipment_id", *EVENT_SENSORS)
    stored = store.score_requests(asked, version=1)
    direct = ml.score_request_aggregate(first, asked)
    same = stored.alias("s").join(direct.alias("d"), "equipment_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("s.prediction").eqNullSafe(F.col("d.prediction"))).alias("same")).first()
    less = features.equipment_features(asked.drop("rpm").withColumn("extra", F.lit(1.0)), "equipment_id")
    drift = {r["state"]: r["n"] for r in store.drift(less, 1).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    try:
        store.score_requests(asked.drop("rpm"), version=1).count()
        refused = 0
    except model_store.SchemaMismatch:
        refused = 1
    lenient = store.score_requests(asked.drop("rpm"), version=1, strict=False).count()
    template = ml.template_frame(spark, [r["feature"] for r in store.schema(1).orderBy("place").collect()])
    return _facts(spark, versions=len(store.versions()), latest=store.versions()[-1], scored=same["n"], same_as_unsaved=same["same"], features=len(xcols),
                  ok=drift.get("ok", 0), missing=drift.get("missing", 0), extra=drift.get("extra", 0), refused=refused, lenient=lenient,
                  template_columns=len(template.columns), second_features=store.schema().count())


def q_forest_walk(spark, sf_dir):
    """M03 + M04 + M06: a forest as a table of nodes; every row walked down its trees by joins gives the model's prediction."""
    _, data, xcols = _training(spark, sf_dir)
    model = ml.train(data, xcols, "rul", ml.forest(TREES, DEPTH))
    nodes = model_store.forest_nodes(model)
    walked = model_store.walk_forest(model, nodes, data, "equipment_id")
    both = ml.predict(model, data).join(walked, "equipment_id")
    facts = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("prediction") - F.col("walked")) < 1e-9).alias("same")).first()
    shape = nodes.agg(F.count_distinct("tree").alias("trees"), (F.count_if(F.col("feature") < 0) - F.count_if(F.col("feature") >= 0)).alias("excess")).first()
    return _facts(spark, rows=facts["n"], same=facts["same"], trees=shape["trees"], leaves_over_splits=shape["excess"])


def q_boosted_trees(spark, sf_dir):
    """Gradient boosting with the loss of both sides after every tree."""
    _, data, xcols = _training(spark, sf_dir)
    data = cut_lineage(split.split(data, "equipment_id"))
    train, held = (data.filter(F.col("split") == s) for s in ("train", "test"))
    model, losses = model_store.boost(train, held, xcols, "rul", ROUNDS, 3)
    rows = losses.orderBy("iteration").collect()
    error = ml.regression_metrics(ml.predict(model, train), "rul", "prediction").first()["rmse"]
    spread = train.agg(F.stddev_pop("rul")).first()[0]
    return _facts(spark, rows=train.count(), iterations=len(rows), losses_fall=all(a["train_loss"] >= b["train_loss"] for a, b in zip(rows, rows[1:])),
                  beats_mean=error < spread, last_loss_is_the_error=abs(rows[-1]["train_loss"] - error**2) < 1e-6 * spread**2,
                  held_losses=sum(r["held_loss"] > 0 for r in rows))


# --- whole jobs -----------------------------------------------------------------------

def _csv(df, path: str) -> str:
    files.write_table(df, path, fmt="csv")
    return path


def _three_tables(spark, sf_dir) -> dict[str, str]:
    """The events as the three canonical CSV tables: sensor, an empty maintenance log, operational (views)."""
    rd = event_readings(spark, sf_dir)
    text = F.date_format("timestamp", _TIME).alias("timestamp")
    sensor = rd.filter("event_type <> 'view'").select(text, "equipment_id", "vibration", "temperature", "pressure", "current", "rpm", "degradation_level", "failure_imminent")
    operational = rd.filter("event_type = 'view'").select(text, "equipment_id", F.col("value").alias("production_rate"), F.lit("A").alias("shift"), F.lit("OP_001").alias("operator_id"),
                                                          F.lit(20.0).alias("ambient_temperature"), F.lit(50.0).alias("ambient_humidity"), F.lit("Type_A").alias("product_type"))
    path = _folder(spark, "tables")
    header = ",".join(f.name for f in files.MAINTENANCE_SCHEMA)
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{path}/maintenance")
    return {"sensor": _csv(sensor, f"{path}/sensor"), "maintenance": f"{path}/maintenance", "operational": _csv(operational, f"{path}/operational")}


def q_dataset_job(spark, sf_dir):
    """E05 + E04 + S04 + S05 + S13: the registry job on CSV files; every output, the unwritten empty table, and a rerun that skips."""
    paths, out = _three_tables(spark, sf_dir), _folder(spark, "dataset")
    cfg = jobs.JobConfig(trees=TREES, depth=DEPTH)
    first = jobs.dataset_job(spark, "csv", out, cfg, **paths)
    again = jobs.dataset_job(spark, "csv", out, cfg, **paths)
    other = jobs.dataset_job(spark, "csv", out, jobs.JobConfig(trees=2, depth=2), **paths)
    count = lambda name: spark.read.parquet(f"{out}/{name}").count()
    try:
        jobs.dataset_job(spark, "csv", out, cfg, **(paths | {"sensor": f"{paths['sensor']}-gone"}))
        missing = 0
    except files.MissingSourceError:
        missing = 1
    try:
        files.load_dataset("none such", spark)
        unknown = 0
    except ValueError:
        unknown = 1
    return _facts(spark, sensor=count("raw/sensor"), operational=count("raw/operational"), maintenance_written=files.path_exists(spark, f"{out}/raw/maintenance"),
                  features=count("features"), labels=count("labels"), ranges=files.read_ranges_json(spark, f"{out}/expected_ranges").count(),
                  profile=int(first["profile"]["record_count"]), model=len(ml.TrainedModel.load(spark, f"{out}/model").feature_columns) > 10,
                  steps=len(first["ran"]), rerun_steps=len(again["ran"]), rerun_skips=len(again["skipped"]), changed_steps=len(other["ran"]),
                  same_metrics=first["metrics"] == again["metrics"], missing_raises=missing, unknown_raises=unknown)


def q_features_job(spark, sf_dir):
    """E03 + E07, feature half: features and labels of a stored sensor table, read back from what the job wrote."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    src, out = _folder(spark, "sensor"), _folder(spark, "features")
    rd.select("event_id", "timestamp", "equipment_id", "vibration", "temperature", (F.col("tool_wear") / 300.0).alias("degradation_level")).write.parquet(src)
    jobs.features_job(spark, src, out, ("timestamp", "event_id"))
    feats = spark.read.parquet(f"{out}/features").select("equipment_id", *[f"{c}_{s}" for c in ("vibration", "temperature") for s in ("mean", "std", "max", "min")])
    return finish(feats.join(spark.read.parquet(f"{out}/labels"), "equipment_id"))


def q_retrain_job(spark, sf_dir):
    """E07, training half: a model retrained from the stored tables, as CSV and as Parquet."""
    _, data, xcols = _training(spark, sf_dir)
    out = _folder(spark, "retrain")
    feats, labels = data.drop("rul"), data.select("equipment_id", "rul")
    files.write_table(feats, f"{out}/features")
    _csv(labels, f"{out}/labels.csv")
    res = jobs.retrain_job(spark, f"{out}/features", f"{out}/labels.csv", out, jobs.JobConfig(trees=TREES, depth=DEPTH))
    back = ml.TrainedModel.load(spark, f"{out}/model")
    return _facts(spark, features=len(back.feature_columns), trained_rows=back.scaler.rows or res.model.scaler.rows, scored=ml.predict(back, data).count(),
                  metrics=len(res.metrics), error_is_finite=0 <= res.metrics["mae"] <= res.metrics["rmse"])


def q_simple_job(spark, sf_dir):
    """The simple pipeline; R² on both sides, that of the training side above that of the mean."""
    res = jobs.simple_job(spark, event_readings(spark, sf_dir, with_degradation=False), _folder(spark, "simple"), ("event_id",), TREES, DEPTH)
    return _facts(spark, sides=len(res["r2"]), fits=res["r2"]["train"] > 0, bounded=all(v <= 1 for v in res["r2"].values()))


def q_profile_job(spark, sf_dir):
    """Every table of the profile job, in long form."""
    rd = event_readings(spark, sf_dir, with_degradation=False).withColumn("failure_text", F.when(F.col("failure_imminent"), "broken belt").otherwise(F.col("event_type")))
    tables = jobs.profile_job(rd.select("equipment_id", "timestamp", "vibration", "failure_imminent", "failure_text"))
    row = lambda t, k, v: tables[t].select(F.lit(t).alias("part"), k.cast("string").alias("name"), v.cast("double").alias("value"))
    out = row("profile", F.lit("records"), F.col("record_count")).unionByName(row("profile", F.lit("equipment"), F.col("equipment_count")))
    out = out.unionByName(row("failure_rates", F.col("column"), F.col("failure_rate_pct"))).unionByName(row("distribution_failure_text", F.col("failure_text"), F.col("n")))
    return finish(out)


def q_fleet_job(spark, sf_dir):
    """E08 + S10: the batch page's reports and the scored CSV, read back from files."""
    scored = fleet.score_batch(event_readings(spark, sf_dir, with_degradation=False)).select("event_id", "equipment_id", "health_score", "failure_probability", "predicted_rul_hours", "maintenance_priority", *EVENT_SENSORS)
    out = _folder(spark, "fleet")
    jobs.fleet_report(scored, out)
    back = files.read_csv(spark, f"{out}/batch_analysis_results", None, timestamp=None)
    rows = back.groupBy("maintenance_priority").agg(F.count(F.lit(1)).alias("n"), F.avg("health_score").alias("mean")).select(
        F.lit("scored").alias("part"), F.col("maintenance_priority").alias("name"), "n", "mean")
    tiers = spark.read.parquet(f"{out}/tiers").select(F.lit("tiers").alias("part"), F.col("tier").alias("name"), F.col("n").cast("long").alias("n"), F.lit(None).cast("double").alias("mean"))
    return finish(rows.unionByName(tiers))


# --- further rows of the survey ---------------------------------------------------------

def q_null_features(spark, sf_dir):
    """statistics over columns with NULLs, and one that is NULL in every row of some equipment."""
    rd = event_readings(spark, sf_dir, with_degradation=False, gaps=True).withColumn("current", F.when(F.col("equipment_id").cast("int") % 3 != 0, F.col("current")))
    return finish(features.equipment_features(rd, "equipment_id", ["temperature", "current"]))


def q_asof_fallback(spark, sf_dir):
    """An operational table without the join's key leaves the readings as they are."""
    rd = event_readings(spark, sf_dir, with_degradation=False).select("event_id", "timestamp", "equipment_id", "vibration")
    right = rd.select(F.col("equipment_id").alias("machine"), "timestamp", F.lit(1.0).alias("rate"))
    return finish(asof_join(rd, right, by="equipment_id", on_error="left"))


def q_end_of_life(spark, sf_dir):
    """P07, third form: one maintenance row per unit, at its last cycle."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_orderkey"])
    raw = li.select(F.col("l_suppkey").alias("unit"), (F.col("l_orderkey") % 5000).alias("cycle"))
    out = normalize.cmapss_maintenance(raw)
    return finish(out.select("timestamp", "equipment_id", "maintenance_type", "downtime_hours"))


def q_scored_warnings(spark, sf_dir):
    """A stream validated against ranges that fire, its warnings and scores kept."""
    rd = event_readings(spark, sf_dir, with_degradation=False)
    path, out = _folder(spark, "readings"), _folder(spark, "scored")
    rd.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(rd.schema).option("maxFilesPerTrigger", 1).parquet(path)
    scored = streaming.scoring_stream(stream, {"vibration": (2.97, 3.03), "tool_wear": (5.0, 290.0)}).select("event_id", "timestamp", "health_score", "data_quality_warnings")
    streaming.append_history(scored, out, _folder(spark, "scored-checkpoint")).awaitTermination()
    back = spark.read.parquet(out)
    return finish(back.select("event_id", "health_score", F.coalesce(F.size("data_quality_warnings"), F.lit(0)).alias("n"), F.concat_ws("; ", "data_quality_warnings").alias("warnings")))


def q_latest_ties(spark, sf_dir):
    """The latest row of each equipment where many rows share a time: all columns come from one row."""
    rd = event_readings(spark, sf_dir, with_degradation=False).select("event_id", F.date_trunc("month", "timestamp").alias("timestamp"), "equipment_id", "k", "value")
    return finish(streaming.latest_predictions(rd, "equipment_id", "timestamp", ["k", "event_id", "value"]))


def queries() -> dict:
    return {f.__name__[2:]: f for f in (q_request_files, q_stored_model, q_forest_walk, q_boosted_trees, q_dataset_job, q_features_job, q_retrain_job, q_simple_job, q_profile_job,
                                        q_fleet_job, q_null_features, q_asof_fallback, q_end_of_life, q_scored_warnings, q_latest_ties)}


# --- SQL --------------------------------------------------------------------------

def _fact_sql(source: str, **facts) -> str:
    return f"WITH {source}\n" + "\nUNION ALL ".join(f"SELECT '{k}' AS fact, CAST(({v}) AS BIGINT) AS value" for k, v in facts.items())


def oracle_sql() -> dict[str, str]:
    from vigil.plans.oracle import _ev, _scored, _stat4, _tier
    rd, gaps = "WITH " + _ev(), "WITH " + _ev(True)
    machines = "(SELECT count(DISTINCT user_id) FROM events)"
    n = f"n AS (SELECT count(DISTINCT user_id) AS n FROM events)"
    sensors = [s for s in EVENT_SENSORS]
    listed = lambda extra: ", ".join([extra] + [f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in sensors])
    return {
        "request_files": f"""{gaps},
r AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'batch' ELSE 'single' END AS form, event_id // 30 AS grp,
    CASE WHEN event_id % 7 <> 0 OR (event_id % 3 = 0 AND event_id % 21 <> 0) THEN equipment_id END AS eq FROM rd),
b AS (SELECT *, CASE WHEN form = 'single' THEN event_id % 11 = 0 ELSE grp % 17 = 0 END AS broken FROM r),
m AS (SELECT *, concat_ws(',', {listed("CASE WHEN form = 'batch' AND eq IS NULL THEN 'equipment_id' END")}) AS missing FROM b WHERE NOT broken),
j AS (SELECT *, CASE WHEN missing <> '' THEN 'incomplete' WHEN event_id % 13 = 0 THEN 'wrong type' ELSE '' END AS reason FROM m)
SELECT form, event_id, coalesce(eq, 'unknown') AS equipment_id, CASE WHEN reason = '' THEN round(temperature, 6) END AS temperature, reason,
  CASE reason WHEN 'incomplete' THEN missing WHEN 'wrong type' THEN 'rpm' ELSE '' END AS fields, CAST(1 AS BIGINT) AS n FROM j
UNION ALL SELECT 'single', NULL, NULL, NULL, 'malformed', '', count(*) FROM b WHERE broken AND form = 'single' HAVING count(*) > 0
UNION ALL SELECT 'batch', NULL, NULL, NULL, 'malformed', '', count(DISTINCT grp) FROM b WHERE broken AND form = 'batch' HAVING count(*) > 0""",
        "stored_model": _fact_sql(n, versions="2", latest="2", scored=machines, same_as_unsaved=machines, features="24", ok="20", missing="4", extra="4", refused="1",
                                  lenient=machines, template_columns="24", second_features="6"),
        "forest_walk": _fact_sql(n, rows=machines, same=machines, trees=str(TREES), leaves_over_splits=str(TREES)),
        "boosted_trees": _fact_sql(n, rows="(SELECT n - ceil(0.2 * n) FROM n)", iterations=str(ROUNDS), losses_fall="1", beats_mean="1", last_loss_is_the_error="1", held_losses=str(ROUNDS)),
        "dataset_job": _fact_sql("""s AS (SELECT count(*) AS n, count(DISTINCT user_id) AS m FROM events WHERE event_type <> 'view')""",
                                 sensor="(SELECT n FROM s)", operational="(SELECT count(*) FROM events WHERE event_type = 'view')", maintenance_written="0", features="(SELECT m FROM s)",
                                 labels="(SELECT m FROM s)", ranges="5", profile="(SELECT n FROM s)", model="1", steps="4", rerun_steps="0", rerun_skips="4", changed_steps="1",
                                 same_metrics="1", missing_raises="1", unknown_raises="1"),
        "features_job": f"""{rd},
lp AS (SELECT equipment_id, tool_wear / 300.0 AS d FROM rd QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY "timestamp" DESC, event_id DESC) = 1),
f AS (SELECT equipment_id, {_stat4("vibration")}, {_stat4("temperature")} FROM rd GROUP BY 1)
SELECT f.*, round(greatest(CAST(0.0 AS DOUBLE), (1.0 - d) * 1000.0), 6) AS rul,
  round(least(greatest(CAST(0.0 AS DOUBLE), (1.0 - d) * 1000.0) / 1000.0, CAST(0.95 AS DOUBLE)), 6) AS failure_probability FROM f JOIN lp USING (equipment_id)""",
        "retrain_job": _fact_sql(n, features="24", trained_rows="(SELECT n - ceil(0.2 * n) FROM n)", scored=machines, metrics="3", error_is_finite="1"),
        "simple_job": _fact_sql(n, sides="2", fits="1", bounded="1"),
        "profile_job": """
WITH t AS (SELECT *, CASE WHEN event_type = 'error' THEN 'broken belt' ELSE event_type END AS failure_text FROM events)
SELECT 'profile' AS part, 'records' AS name, CAST(count(*) AS DOUBLE) AS value FROM t
UNION ALL SELECT 'profile', 'equipment', count(DISTINCT user_id) FROM t
UNION ALL SELECT 'failure_rates', 'failure_imminent', round(avg(CASE WHEN event_type = 'error' THEN 100.0 ELSE 0.0 END), 6) FROM t
UNION ALL SELECT 'failure_rates', 'failure_text', round(avg(CASE WHEN event_type = 'error' THEN 100.0 ELSE 0.0 END), 6) FROM t
UNION ALL SELECT 'distribution_failure_text', failure_text, n FROM (SELECT failure_text, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, failure_text LIMIT 10)""",
        "fleet_job": "WITH " + _scored() + f""",
t AS (SELECT {_tier('health_score', True)} AS tier FROM sc),
dim AS (SELECT * FROM (VALUES ('Excellent (80-100)'), ('Good (60-79)'), ('Fair (40-59)'), ('Poor (0-39)')) d(tier))
SELECT 'scored' AS part, maintenance_priority AS name, count(*) AS n, round(avg(health_score), 6) AS mean FROM sc GROUP BY 2
UNION ALL SELECT 'tiers', dim.tier, count(t.tier), NULL FROM dim LEFT JOIN t ON dim.tier = t.tier GROUP BY 2""",
        "null_features": f"""{gaps},
x AS (SELECT equipment_id, temperature, CASE WHEN CAST(equipment_id AS INTEGER) % 3 <> 0 THEN current END AS current FROM rd)
SELECT equipment_id, {_stat4("temperature")}, {_stat4("current")} FROM x GROUP BY 1""",
        "asof_fallback": f"""{rd} SELECT event_id, "timestamp", equipment_id, round(vibration, 6) AS vibration FROM rd""",
        "end_of_life": """
SELECT TIMESTAMP '2023-01-01 00:00:00' + INTERVAL 1 HOUR * max(l_orderkey % 5000) AS "timestamp", printf('Engine_%03d', l_suppkey) AS equipment_id,
  'corrective' AS maintenance_type, CAST(48.0 AS DOUBLE) AS downtime_hours FROM lineitem GROUP BY l_suppkey""",
        "scored_warnings": "WITH " + _scored() + """,
w AS (SELECT *, list_filter([CASE WHEN vibration < 2.97 OR vibration > 3.03 THEN 'vibration=' || CAST(vibration AS VARCHAR) || ' outside expected range [2.97, 3.03]' END,
  CASE WHEN tool_wear < 5.0 OR tool_wear > 290.0 THEN 'tool_wear=' || CAST(tool_wear AS VARCHAR) || ' outside expected range [5.00, 290.00]' END], lambda x: x IS NOT NULL) AS l FROM sc)
SELECT event_id, round(health_score, 6) AS health_score, CAST(len(l) AS INTEGER) AS n, array_to_string(l, '; ') AS warnings FROM w""",
        "latest_ties": f"""{rd},
x AS (SELECT *, date_trunc('month', "timestamp") AS t FROM rd)
SELECT equipment_id, k, event_id, round(value, 6) AS value FROM x QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY t DESC, k DESC, event_id DESC, value DESC) = 1""",
    }
