"""Fleet batch report (R09, R10, A15–A18, A25, R12/R13 matrix, E08).

``score_batch`` is a row-level projection (works on streams too).  The report
aggregates are all single-pass ``agg`` / ``groupBy`` jobs; category tables that
must show zero counts are completed with a tiny literal dimension joined on the
aggregated (already small) result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import rules as R

HIST_BINS = 20
HIST_MAX = 0.95
RISK_LEVELS = ("High", "Medium", "Low")


def score_batch(df: DataFrame) -> DataFrame:
    """R09 + R10: heuristic health, probability, RUL and priority; keeps every input column."""
    health = R.batch_health_score("vibration", "temperature", "pressure", "tool_wear")
    prob = R.batch_failure_probability("vibration", "temperature", "tool_wear")
    scored = df.withColumns({
        "health_score": health,
        "failure_probability": prob,
        "predicted_rul_hours": R.batch_rul("tool_wear"),
    })
    return scored.withColumn("maintenance_priority",
                             R.maintenance_priority("failure_probability", "health_score"))


def _dimension(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_ord int, {name} string")


def health_tiers(scored: DataFrame, labelled: bool = True) -> DataFrame:
    """Equipment count per health tier; tiers with no rows appear with 0."""
    counts = scored.groupBy(R.health_tier("health_score", labelled).alias("tier")) \
        .agg(F.count(F.lit(1)).alias("n"))
    names = [R.HEALTH_TIER_LABELS[t] if labelled else t for t in R.HEALTH_TIER_ORDER]
    dim = _dimension(scored.sparkSession, "tier", names)
    # both sides have at most four rows
    return dim.join(counts, "tier", "left").select(
        "tier", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def risk_matrix(scored: DataFrame) -> DataFrame:
    """R12 x R13: equipment count per (risk, impact)."""
    return scored.groupBy(R.risk_level("failure_probability").alias("risk_level"),
                          R.impact_level("health_score").alias("impact_level")) \
        .agg(F.count(F.lit(1)).alias("n"))


def prob_bucket(prob, bins: int = HIST_BINS, top: float = HIST_MAX):
    """A16 bucket 1..bins of [0, top]; the upper edge falls in the last bucket."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.least(F.floor(p / top * bins).cast("int") + 1, F.lit(bins))


def prob_histogram(scored: DataFrame, bins: int = HIST_BINS, top: float = HIST_MAX) -> DataFrame:
    """Equal-width histogram of failure probability (non-empty buckets)."""
    b = prob_bucket("failure_probability", bins, top)
    width = top / bins
    return scored.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).withColumns({
        "lower_edge": (F.col("bucket") - 1) * width,
        "upper_edge": F.col("bucket") * width,
    })


def fleet_summary(scored: DataFrame) -> DataFrame:
    """One row — average health, high-risk count, average RUL, estimated cost."""
    high = F.count_if(F.col("failure_probability") > R.HIGH_RISK_PROB)
    medium = F.count_if(F.col("maintenance_priority") == "medium")
    return scored.agg(
        F.count(F.lit(1)).alias("equipment"),
        F.avg("health_score").alias("avg_health_score"),
        high.alias("high_risk_count"),
        F.avg("predicted_rul_hours").alias("avg_rul_hours"),
        (high * R.COST_HIGH_RISK + medium * R.COST_MEDIUM_PRIORITY).cast("long").alias("maintenance_cost"),
    )


def fleet_status_shares(scored: DataFrame) -> DataFrame:
    """Share (percent; NULL for an empty table) of healthy / attention / critical equipment and alert count."""
    tier = R.health_tier("health_score")
    n = F.count(F.lit(1))
    return scored.agg(
        F.try_divide(F.count_if(tier.isin("Excellent", "Good")) * 100.0, n).alias("healthy_pct"),
        F.try_divide(F.count_if(tier == "Fair") * 100.0, n).alias("attention_pct"),
        F.try_divide(F.count_if(tier == "Poor") * 100.0, n).alias("critical_pct"),
        F.count_if(F.col("maintenance_priority") == "high").alias("alerts"),
    )


def fleet_aggregates(scored: DataFrame, bins: int = HIST_BINS, top: float = HIST_MAX) -> DataFrame:
    """E08 in one pass: tiers, risk matrix, histogram and summary as grouping sets.

    One scan and one (partial-aggregated) shuffle for all four reports; the
    result has a few dozen rows and a ``report`` column naming the grouping.
    """
    t = scored.select(
        R.health_tier("health_score", True).alias("tier"),
        R.risk_level("failure_probability").alias("risk_level"),
        R.impact_level("health_score").alias("impact_level"),
        prob_bucket("failure_probability", bins, top).alias("bucket"),
        "health_score", "failure_probability", "predicted_rul_hours", "maintenance_priority")
    high = F.count_if(F.col("failure_probability") > R.HIGH_RISK_PROB)
    medium = F.count_if(F.col("maintenance_priority") == "medium")
    g = t.groupingSets([["tier"], ["risk_level", "impact_level"], ["bucket"], []],
                       "tier", "risk_level", "impact_level", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("health_score").alias("avg_health_score"),
        high.alias("high_risk_count"),
        F.avg("predicted_rul_hours").alias("avg_rul_hours"),
        (high * R.COST_HIGH_RISK + medium * R.COST_MEDIUM_PRIORITY).cast("long").alias("maintenance_cost"),
        F.grouping_id().alias("_gid"))
    # grouping_id bits follow the grouping columns (tier, risk, impact, bucket)
    report = (F.when(F.col("_gid") == 0b0111, F.lit("tiers"))
              .when(F.col("_gid") == 0b1001, F.lit("risk_matrix"))
              .when(F.col("_gid") == 0b1110, F.lit("histogram"))
              .otherwise(F.lit("summary")))
    return g.withColumn("report", report).drop("_gid")


def reports_from_aggregates(agg: DataFrame, bins: int = HIST_BINS, top: float = HIST_MAX) -> dict[str, DataFrame]:
    """Split ``fleet_aggregates`` into the report tables of A15, R12/R13, A16 and A18."""
    spark = agg.sparkSession
    names = [R.HEALTH_TIER_LABELS[t] for t in R.HEALTH_TIER_ORDER]
    dim = _dimension(spark, "tier", names)
    tiers = dim.join(agg.filter(F.col("report") == "tiers").select("tier", "n"), "tier", "left").select(
        "tier", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
    width = top / bins
    hist = agg.filter(F.col("report") == "histogram").select("bucket", "n").withColumns({
        "lower_edge": (F.col("bucket") - 1) * width, "upper_edge": F.col("bucket") * width})
    return {
        "tiers": tiers,
        "risk_matrix": agg.filter(F.col("report") == "risk_matrix").select("risk_level", "impact_level", "n"),
        "histogram": hist,
        "summary": agg.filter(F.col("report") == "summary").select(
            F.col("n").alias("equipment"), "avg_health_score", "high_risk_count", "avg_rul_hours",
            "maintenance_cost"),
    }
