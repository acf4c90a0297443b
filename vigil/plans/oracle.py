"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on the driver's pre-registered views of the parquet tables and
must produce the same columns (names and values, doubles rounded to 6 digits)
as the Spark query of the same name in ``catalog``.
"""

from __future__ import annotations

from vigil.plans import more, stored, streams, whole


def _ev(gaps: bool = False) -> str:
    """CTE ``rd``: events as sensor readings (FIXTURES §3), with degradation."""
    value = "CASE WHEN event_type <> 'error' THEN value END" if gaps else "value"
    return f"""
ev AS (
  SELECT event_id, ts AS "timestamp", CAST(user_id AS VARCHAR) AS equipment_id, user_id,
         event_type, {value} AS value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
rd AS (
  SELECT event_id, "timestamp", equipment_id, event_type, value, k,
         CAST(2.95 AS DOUBLE) + k / 1000.0 AS vibration,
         CAST(305.0 AS DOUBLE) + value / 50.0 AS temperature,
         CAST(100 + k AS DOUBLE) AS pressure,
         least(CAST(70.0 AS DOUBLE), CAST(10.0 AS DOUBLE) + value / 5.0) AS current,
         CAST(1000 + 10 * k AS DOUBLE) AS rpm,
         CAST((user_id * 7 + event_id) % 300 AS DOUBLE) AS tool_wear,
         event_type = 'error' AS failure_imminent,
         CAST(row_number() OVER (PARTITION BY equipment_id ORDER BY "timestamp", event_id) AS DOUBLE)
           / count(*) OVER (PARTITION BY equipment_id) AS degradation_level
  FROM ev)"""


def _scored(gaps: bool = False) -> str:
    """CTE ``sc``: batch heuristic scoring (R09, R10) of the readings."""
    return _ev(gaps) + """,
sc0 AS (
  SELECT *,
    greatest(0.0, 100.0 - (abs(vibration - 3.0) * 1000.0 + abs(temperature - 310.0) * 2.0
                         + abs(pressure - 150.0) * 0.5 + tool_wear * 0.1)) AS health_score,
    least(0.95, abs(vibration - 3.0) * 10.0 + abs(temperature - 310.0) * 0.05
                + tool_wear * 0.003) AS failure_probability,
    greatest(0.0, 500.0 - tool_wear * 2.0) AS predicted_rul_hours
  FROM rd),
sc AS (
  SELECT *,
    CASE WHEN failure_probability > 0.7 OR health_score < 40 THEN 'high'
         WHEN failure_probability > 0.3 OR health_score < 60 THEN 'medium'
         ELSE 'low' END AS maintenance_priority
  FROM sc0)"""


def _stat4(col: str, src: str = None) -> str:
    c = src or col
    parts = []
    for suffix, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")):
        parts.append(f"CASE WHEN count({c}) = 0 THEN 0.0 ELSE round(CAST({fn}({c}) AS DOUBLE), 6) END"
                     f" AS {col}_{suffix}")
    return ",\n  ".join(parts)


LINEITEM_SENSORS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
EVENT_SENSORS = ("vibration", "temperature", "pressure", "current", "rpm", "tool_wear")


def equipment_features() -> str:
    stats = ",\n  ".join(_stat4(c) for c in LINEITEM_SENSORS)
    return f"""
SELECT CAST(l_suppkey AS VARCHAR) AS equipment_id,
  {stats}
FROM lineitem GROUP BY l_suppkey"""


def batch_health() -> str:
    return "WITH " + _scored() + """
SELECT event_id, equipment_id, round(vibration, 6) AS vibration, round(temperature, 6) AS temperature,
       round(pressure, 6) AS pressure, round(tool_wear, 6) AS tool_wear,
       round(health_score, 6) AS health_score, round(failure_probability, 6) AS failure_probability,
       round(predicted_rul_hours, 6) AS predicted_rul_hours, maintenance_priority
FROM sc"""


def asof_enrich() -> str:
    return """
WITH p AS (SELECT event_id, ts, user_id, value FROM events WHERE event_type <> 'view'),
     v AS (SELECT event_id AS view_event_id, ts AS view_ts, user_id, value AS view_value
           FROM events WHERE event_type = 'view')
SELECT p.event_id, p.ts, p.user_id, round(p.value, 6) AS value, CAST(v.view_event_id AS VARCHAR) AS view_event_id,
       v.view_ts,
       round(v.view_value, 6) AS view_value
FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.view_ts"""




def fleet_features() -> str:
    stats = ",\n  ".join(_stat4(c) for c in LINEITEM_SENSORS)
    return f"SELECT\n  {stats}\nFROM lineitem"


def equipment_labels() -> str:
    return "WITH " + _ev() + """,
lp AS (SELECT equipment_id, tool_wear / 300.0 AS d FROM rd
       QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY "timestamp" DESC, event_id DESC) = 1),
lr AS (SELECT equipment_id, greatest(CAST(0.0 AS DOUBLE), (1.0 - d) * 1000.0) AS rul FROM lp)
SELECT equipment_id, round(rul, 6) AS rul,
       round(least(rul / 1000.0, CAST(0.95 AS DOUBLE)), 6) AS failure_probability
FROM lr"""


def heuristic_labels() -> str:
    return "WITH " + _ev() + """,
m AS (SELECT avg(vibration) AS v, avg(temperature) AS t, avg(tool_wear) AS w FROM rd),
r AS (SELECT greatest(1000.0 - v * 10.0
                      - CASE WHEN t > 300.0 THEN (t - 300.0) * 2.0 ELSE 0.0 END
                      - w * 0.5, 50.0) AS rul FROM m)
SELECT DISTINCT rd.equipment_id, round(CAST(r.rul AS DOUBLE), 6) AS rul,
       round(least(CAST(r.rul AS DOUBLE) / 1000.0, CAST(0.95 AS DOUBLE)), 6) AS failure_probability
FROM rd, r"""


def simple_features() -> str:
    return "WITH " + _ev() + """,
p AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY "timestamp", event_id) - 1 AS pos
      FROM rd)
SELECT equipment_id,
  round(avg(vibration), 6) AS vibration_mean,
  round(stddev_samp(vibration), 6) AS vibration_std,
  round(avg(temperature), 6) AS temperature_mean,
  round(CASE WHEN count(temperature) < count(*) OR count(*) < 2 THEN NULL
             ELSE regr_slope(temperature, CAST(pos AS DOUBLE)) END, 6) AS temperature_trend,
  round(avg(pressure), 6) AS pressure_mean,
  round(avg(current), 6) AS current_mean,
  round(greatest(1000.0 - avg(vibration) * 100.0, 100.0), 6) AS rul
FROM p GROUP BY equipment_id"""


def temperature_trend() -> str:
    return "WITH " + _ev() + """,
p AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY "timestamp", event_id) - 1 AS pos
      FROM rd)
SELECT equipment_id,
  round(CASE WHEN count(temperature) < count(*) OR count(*) < 2 THEN NULL
             ELSE regr_slope(temperature, CAST(pos AS DOUBLE)) END, 6) AS temperature_trend,
  CAST(count(*) AS BIGINT) AS n
FROM p GROUP BY equipment_id"""


def _ranges_union(src: str, cols, sigmas: float) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS sensor, avg({c}) AS mean, stddev_samp({c}) AS std FROM {src}""")
    inner = "\nUNION ALL\n".join(parts)
    return f"""(SELECT sensor, greatest(CAST(0.0 AS DOUBLE), mean - {sigmas} * std) AS mn,
        mean + {sigmas} * std AS mx, mean, std FROM ({inner}) q)"""


def expected_ranges() -> str:
    return f"""
SELECT sensor, round(mn, 6) AS "min", round(mx, 6) AS "max", round(mean, 6) AS mean, round(std, 6) AS std
FROM {_ranges_union('lineitem', LINEITEM_SENSORS, 3.0)} r"""


def range_warnings() -> str:
    longs = "\nUNION ALL\n".join(
        f"SELECT event_id, equipment_id, '{c}' AS sensor, {c} AS value FROM rd" for c in EVENT_SENSORS)
    return "WITH " + _ev() + f""",
rg AS {_ranges_union('rd', EVENT_SENSORS, 1.0)},
lg AS ({longs}),
bad AS (SELECT lg.*, rg.mn, rg.mx FROM lg JOIN rg USING (sensor) WHERE lg.value < rg.mn OR lg.value > rg.mx),
w AS (SELECT *, printf('%s=%s outside expected range [%.2f, %.2f]', sensor, CAST(value AS VARCHAR), mn, mx)
              AS warning FROM bad)
SELECT event_id, equipment_id, sensor, round(value, 6) AS value, warning,
       equipment_id || ': ' || warning AS flat_warning
FROM w"""


def interpolate_gaps() -> str:
    win = 'PARTITION BY user_id ORDER BY ts, event_id'
    return f"""
WITH r AS (
  SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v,
         row_number() OVER ({win}) - 1 AS pos
  FROM events),
s AS (
  SELECT *,
    last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER
      ({win} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0,
    last_value(v IGNORE NULLS) OVER ({win} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
    first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER
      ({win} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1,
    first_value(v IGNORE NULLS) OVER ({win} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1
  FROM r)
SELECT event_id, CAST(user_id AS VARCHAR) AS equipment_id,
  round(coalesce(v,
    CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL AND p1 <> p0
         THEN v0 + (v1 - v0) * CAST(pos - p0 AS DOUBLE) / CAST(p1 - p0 AS DOUBLE) END,
    v0, v1), 6) AS value
FROM s"""


def clean_enrich() -> str:
    win = 'PARTITION BY user_id ORDER BY ts, event_id'
    return f"""
WITH s0 AS (
  SELECT event_id, ts, user_id, CASE WHEN event_type <> 'error' THEN value END AS v,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events WHERE event_type <> 'view'),
r AS (SELECT *, row_number() OVER ({win}) - 1 AS pos FROM s0),
s AS (
  SELECT *,
    last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER
      ({win} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0,
    last_value(v IGNORE NULLS) OVER ({win} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
    first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER
      ({win} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1,
    first_value(v IGNORE NULLS) OVER ({win} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1
  FROM r),
f AS (
  SELECT event_id, ts, user_id,
    coalesce(v, CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL AND p1 <> p0
                     THEN v0 + (v1 - v0) * CAST(pos - p0 AS DOUBLE) / CAST(p1 - p0 AS DOUBLE) END,
             v0, v1) AS value,
    CAST(k AS DOUBLE) AS k
  FROM s),
z1 AS (SELECT count(value) AS n, avg(value) AS mu, stddev_pop(value) AS sd, min(value) AS mn,
              max(value) AS mx FROM f),
f1 AS (SELECT f.* FROM f, z1 WHERE z1.n <= 10 OR (f.value IS NOT NULL AND
        (z1.mn = z1.mx OR abs((f.value - z1.mu) / z1.sd) < 3.0))),
z2 AS (SELECT count(k) AS n, avg(k) AS mu, stddev_pop(k) AS sd, min(k) AS mn, max(k) AS mx FROM f1),
f2 AS (SELECT f1.* FROM f1, z2 WHERE z2.n <= 10 OR (f1.k IS NOT NULL AND
        (z2.mn = z2.mx OR abs((f1.k - z2.mu) / z2.sd) < 3.0))),
op AS (SELECT event_id AS view_event_id, ts AS view_ts, user_id, value AS production_rate
       FROM events WHERE event_type = 'view')
SELECT f2.event_id, f2.ts AS "timestamp", CAST(f2.user_id AS VARCHAR) AS equipment_id,
       round(f2.value, 6) AS value, round(f2.k, 6) AS k,
       CAST(op.view_event_id AS VARCHAR) AS view_event_id, round(op.production_rate, 6) AS production_rate
FROM f2 ASOF LEFT JOIN op ON f2.user_id = op.user_id AND f2.ts >= op.view_ts"""


def zscore_filter() -> str:
    return """
WITH r0 AS (SELECT event_id, user_id, value,
                   CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
s1 AS (SELECT count(value) AS n, avg(value) AS mu, stddev_pop(value) AS sd, min(value) AS mn,
              max(value) AS mx FROM r0),
r1 AS (SELECT r0.* FROM r0, s1 WHERE s1.n <= 10 OR (r0.value IS NOT NULL AND
        (s1.mn = s1.mx OR abs((r0.value - s1.mu) / s1.sd) < 3.0))),
s2 AS (SELECT count(k) AS n, avg(CAST(k AS DOUBLE)) AS mu, stddev_pop(CAST(k AS DOUBLE)) AS sd,
              min(k) AS mn, max(k) AS mx FROM r1),
r2 AS (SELECT r1.* FROM r1, s2 WHERE s2.n <= 10 OR (r1.k IS NOT NULL AND
        (s2.mn = s2.mx OR abs((CAST(r1.k AS DOUBLE) - s2.mu) / s2.sd) < 3.0)))
SELECT event_id, user_id, round(value, 6) AS value, k FROM r2"""


def median_impute() -> str:
    return """
WITH r AS (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN value END AS value,
                  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
m AS (SELECT median(value) AS med FROM r)
SELECT event_id, user_id, round(coalesce(value, m.med), 6) AS value, k FROM r, m"""


def null_report() -> str:
    cols = ",\n  ".join(f"CAST(count(*) - count({c}) AS BIGINT) AS {c}" for c in EVENT_SENSORS)
    total = " + ".join(f"(count(*) - count({c}))" for c in EVENT_SENSORS)
    return "WITH " + _ev(gaps=True) + f"""
SELECT
  {cols},
  CAST({total} AS BIGINT) AS total_missing
FROM rd"""


def _tier(col: str, labelled: bool) -> str:
    lab = {"Excellent": "Excellent (80-100)", "Good": "Good (60-79)", "Fair": "Fair (40-59)",
           "Poor": "Poor (0-39)"} if labelled else {k: k for k in ("Excellent", "Good", "Fair", "Poor")}
    return (f"CASE WHEN {col} >= 80 THEN '{lab['Excellent']}' WHEN {col} >= 60 THEN '{lab['Good']}' "
            f"WHEN {col} >= 40 THEN '{lab['Fair']}' ELSE '{lab['Poor']}' END")


def health_tiers() -> str:
    return "WITH " + _scored() + f""",
t AS (SELECT {_tier('health_score', True)} AS tier FROM sc),
dim AS (SELECT * FROM (VALUES ('Excellent (80-100)'), ('Good (60-79)'), ('Fair (40-59)'), ('Poor (0-39)'))
        d(tier))
SELECT dim.tier, CAST(count(t.tier) AS BIGINT) AS n FROM dim LEFT JOIN t ON dim.tier = t.tier
GROUP BY dim.tier"""


def risk_matrix() -> str:
    return "WITH " + _scored() + """
SELECT CASE WHEN failure_probability > 0.7 THEN 'High' WHEN failure_probability > 0.3 THEN 'Medium'
            ELSE 'Low' END AS risk_level,
       CASE WHEN health_score < 40 THEN 'High' WHEN health_score < 60 THEN 'Medium' ELSE 'Low' END
            AS impact_level,
       CAST(count(*) AS BIGINT) AS n
FROM sc GROUP BY 1, 2"""


def prob_histogram() -> str:
    return "WITH " + _scored() + """,
b AS (SELECT least(CAST(floor(failure_probability / CAST(0.95 AS DOUBLE) * 20) AS INTEGER) + 1, 20)
             AS bucket FROM sc)
SELECT bucket, CAST(count(*) AS BIGINT) AS n,
       round((bucket - 1) * (CAST(0.95 AS DOUBLE) / 20), 6) AS lower_edge,
       round(bucket * (CAST(0.95 AS DOUBLE) / 20), 6) AS upper_edge
FROM b GROUP BY bucket"""


def fleet_summary() -> str:
    return "WITH " + _scored() + """
SELECT CAST(count(*) AS BIGINT) AS equipment,
       round(avg(health_score), 6) AS avg_health_score,
       CAST(count(*) FILTER (WHERE failure_probability > 0.7) AS BIGINT) AS high_risk_count,
       round(avg(predicted_rul_hours), 6) AS avg_rul_hours,
       CAST(count(*) FILTER (WHERE failure_probability > 0.7) * 2500
            + count(*) FILTER (WHERE maintenance_priority = 'medium') * 1000 AS BIGINT) AS maintenance_cost
FROM sc"""


def fleet_status() -> str:
    tier = _tier("health_score", False)
    return "WITH " + _scored() + f""",
t AS (SELECT {tier} AS tier, maintenance_priority FROM sc)
SELECT round(CAST(count(*) FILTER (WHERE tier IN ('Excellent', 'Good')) AS DOUBLE) * 100.0 / count(*), 6)
         AS healthy_pct,
       round(CAST(count(*) FILTER (WHERE tier = 'Fair') AS DOUBLE) * 100.0 / count(*), 6) AS attention_pct,
       round(CAST(count(*) FILTER (WHERE tier = 'Poor') AS DOUBLE) * 100.0 / count(*), 6) AS critical_pct,
       CAST(count(*) FILTER (WHERE maintenance_priority = 'high') AS BIGINT) AS alerts
FROM t"""


def fleet_aggregates() -> str:
    return "WITH " + _scored() + f""",
t AS (SELECT {_tier('health_score', True)} AS tier,
             CASE WHEN failure_probability > 0.7 THEN 'High' WHEN failure_probability > 0.3 THEN 'Medium'
                  ELSE 'Low' END AS risk_level,
             CASE WHEN health_score < 40 THEN 'High' WHEN health_score < 60 THEN 'Medium' ELSE 'Low' END
                  AS impact_level,
             least(CAST(floor(failure_probability / CAST(0.95 AS DOUBLE) * 20) AS INTEGER) + 1, 20) AS bucket,
             health_score, failure_probability, predicted_rul_hours, maintenance_priority FROM sc),
g AS (SELECT tier, risk_level, impact_level, bucket,
             CAST(count(*) AS BIGINT) AS n,
             avg(health_score) AS avg_health_score,
             CAST(count(*) FILTER (WHERE failure_probability > 0.7) AS BIGINT) AS high_risk_count,
             avg(predicted_rul_hours) AS avg_rul_hours,
             CAST(count(*) FILTER (WHERE failure_probability > 0.7) * 2500
                  + count(*) FILTER (WHERE maintenance_priority = 'medium') * 1000 AS BIGINT) AS maintenance_cost,
             grouping(tier, risk_level, impact_level, bucket) AS gid
      FROM t GROUP BY GROUPING SETS ((tier), (risk_level, impact_level), (bucket), ()))
SELECT tier, risk_level, impact_level, CAST(bucket AS DOUBLE) AS bucket, n,
       round(avg_health_score, 6) AS avg_health_score,
       high_risk_count, round(avg_rul_hours, 6) AS avg_rul_hours, maintenance_cost,
       CASE gid WHEN 7 THEN 'tiers' WHEN 9 THEN 'risk_matrix' WHEN 14 THEN 'histogram' ELSE 'summary' END
         AS report
FROM g"""


def _zone(col: str, lo: float, hi: float) -> str:
    frac = f"(({col} - {lo}) / ({hi} - {lo}))"
    return (f"CASE WHEN {frac} < 0.6 THEN 'normal' WHEN {frac} < 0.8 THEN 'warning' "
            f"ELSE 'critical' END")


def rule_labels() -> str:
    return "WITH " + _scored() + f"""
SELECT event_id,
  CASE WHEN maintenance_priority = 'high' THEN 'IMMEDIATE_MAINTENANCE'
       WHEN maintenance_priority = 'medium' THEN 'SCHEDULE_MAINTENANCE'
       ELSE 'CONTINUE_MONITORING' END AS decision,
  CASE WHEN health_score < 40 THEN 'High' WHEN health_score < 60 THEN 'Medium' ELSE 'Low' END
       AS impact_level,
  CASE WHEN maintenance_priority = 'low' THEN 'Low' WHEN maintenance_priority = 'medium' THEN 'Medium'
       ELSE 'High' END AS urgency,
  CASE WHEN health_score > 80 THEN 'green' WHEN health_score > 60 THEN 'yellow'
       WHEN health_score > 40 THEN 'orange' ELSE 'red' END AS grid_status,
  CASE WHEN health_score >= 80 THEN 'Normal Operation' WHEN health_score >= 60 THEN 'Monitoring Required'
       WHEN health_score >= 40 THEN 'Immediate Attention Needed'
       ELSE 'Emergency Shutdown Recommended' END AS action_plan,
  CASE WHEN health_score >= 90 THEN 'Excellent' WHEN health_score >= 80 THEN 'Good'
       WHEN health_score >= 70 THEN 'Fair' WHEN health_score >= 60 THEN 'Watch'
       WHEN health_score >= 40 THEN 'Poor' ELSE 'Critical' END AS health_scale,
  {_tier('health_score', False)} AS health_tier,
  {_zone('temperature', 'CAST(305.0 AS DOUBLE)', 'CAST(314.0 AS DOUBLE)')} AS temperature_zone,
  {_zone('pressure', 'CAST(100.0 AS DOUBLE)', 'CAST(207.0 AS DOUBLE)')} AS pressure_zone,
  rpm > CAST(1000.0 AS DOUBLE) + (CAST(2076.0 AS DOUBLE) - CAST(1000.0 AS DOUBLE)) * 0.9 AS rpm_alarm,
  round(greatest(CAST(0.0 AS DOUBLE), 100.0 - failure_probability * 100.0), 6) AS health_from_probability
FROM sc"""


def prediction_rules() -> str:
    return """
WITH b AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) ELSE 'unknown' END AS equipment_id,
           CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 10 = 0 THEN CAST(0.0 AS DOUBLE) ELSE (value - 20.0) * 60.0 END AS r0
           FROM events),
c AS (SELECT *, CASE WHEN r0 IS NULL OR isnan(r0) THEN CAST(0.0 AS DOUBLE)
                     ELSE least(greatest(r0, CAST(0.0 AS DOUBLE)), CAST(10000.0 AS DOUBLE)) END AS rul FROM b),
d AS (SELECT *, CASE WHEN rul > 0 THEN least(rul / 1000.0, CAST(0.95 AS DOUBLE)) ELSE CAST(0.95 AS DOUBLE) END
               AS p FROM c),
e AS (SELECT *,
        CASE WHEN p > 0.8 OR rul < 24 THEN 'CRITICAL: Schedule immediate maintenance'
             WHEN p > 0.6 OR rul < 168 THEN 'HIGH: Schedule maintenance within 1 week'
             WHEN p > 0.3 OR rul < 720 THEN 'MEDIUM: Plan maintenance within 1 month'
             ELSE 'LOW: Continue monitoring' END AS rec FROM d)
SELECT event_id, equipment_id,
  round(round(rul, 2), 6) AS predicted_rul_hours,
  round(round(p, 4), 6) AS failure_probability,
  CASE WHEN rul > 500 THEN CAST(0.85 AS DOUBLE) WHEN rul > 100 THEN CAST(0.75 AS DOUBLE)
       ELSE CAST(0.65 AS DOUBLE) END AS confidence,
  rec AS maintenance_recommendation,
  TIMESTAMP '2024-02-01 00:00:00' + to_microseconds(CAST(floor(rul * 3600000000.0) AS BIGINT))
    AS predicted_failure_date,
  round(rul / 24.0, 6) AS days_remaining,
  CASE WHEN rul <= 0 THEN 'IMMEDIATE' WHEN rul / 24.0 > 30 THEN 'green' WHEN rul / 24.0 > 7 THEN 'orange'
       ELSE 'red' END AS rul_band,
  CASE WHEN contains(rec, 'CRITICAL') THEN 'IMMEDIATE ACTION REQUIRED'
       WHEN contains(rec, 'MEDIUM') THEN 'SCHEDULE MAINTENANCE' ELSE 'OPERATING NORMALLY' END AS card_class
FROM e"""


def _corr_rows(src: str, cols, by: str | None) -> str:
    parts = []
    for a in cols:
        for b in cols:
            c = f"corr({a}, {b})"
            sel = (f"SELECT {by + ', ' if by else ''}'{a}' AS sensor_a, '{b}' AS sensor_b, "
                   f"CASE WHEN {c} IS NULL OR isnan({c}) THEN NULL "
                   f"ELSE round(greatest(-1.0, least(1.0, {c})), 6) END AS corr "
                   f"FROM {src}{' GROUP BY ' + by if by else ''}")
            parts.append(sel)
    return "\nUNION ALL\n".join(parts)


CORR_COLUMNS = (*EVENT_SENSORS, "failure_probability")


def sensor_corr() -> str:
    return "WITH " + _scored() + "\n" + _corr_rows("sc", CORR_COLUMNS, None)


def sensor_corr_by_equipment() -> str:
    return "WITH " + _ev() + "\n" + _corr_rows("rd", ("temperature", "current", "tool_wear"), "equipment_id")


def urgent_top() -> str:
    return "WITH " + _scored() + """,
r AS (SELECT *, CASE WHEN maintenance_priority = 'high' THEN 1 WHEN maintenance_priority = 'medium' THEN 2
                     ELSE 3 END AS priority_rank FROM sc)
SELECT event_id, equipment_id, maintenance_priority, priority_rank,
       round(failure_probability, 6) AS failure_probability, round(health_score, 6) AS health_score
FROM r"""


def health_trend_daily() -> str:
    return "WITH " + _scored() + """,
d AS (SELECT CAST(CAST("timestamp" AS DATE) AS TIMESTAMP) AS day, avg(health_score) AS avg_health,
             CAST(count(*) AS BIGINT) AS n FROM sc GROUP BY 1)
SELECT day, round(avg_health, 6) AS avg_health, n,
       round(avg_health - lag(avg_health) OVER (ORDER BY day), 6) AS delta,
       """ + _tier("avg_health", False) + """ AS tier
FROM d"""


def alert_digest() -> str:
    longs = "\nUNION ALL\n".join(
        f"SELECT equipment_id, \"timestamp\", '{c}' AS sensor, {c} AS value, CAST({t} AS DOUBLE) AS thr FROM rd"
        for c, t in (("temperature", 314.0), ("vibration", 3.06), ("tool_wear", 250.0)))
    return "WITH " + _ev() + f""",
lg AS ({longs})
SELECT date_trunc('hour', "timestamp") AS window_start, equipment_id, sensor, CAST(count(*) AS BIGINT) AS n
FROM lg WHERE value > thr GROUP BY 1, 2, 3"""


def dataset_profile() -> str:
    return """
SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS equipment_count, CAST(count(*) AS BIGINT) AS record_count,
       min(ts) AS first_timestamp, max(ts) AS last_timestamp
FROM events"""


def failure_rate() -> str:
    return """
WITH t AS (SELECT *, CASE event_type WHEN 'error' THEN 'Bearing MALFUNCTION' WHEN 'click' THEN 'No Failure' WHEN 'signup' THEN NULL
                          WHEN 'view' THEN 'pump failed' ELSE event_type END AS failure_text FROM events)
SELECT 'failure_imminent' AS column_name, 'numeric' AS kind,
       round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS failure_rate_pct
FROM t
UNION ALL
SELECT 'failure_text', 'text',
       round(CAST(count(*) FILTER (WHERE regexp_matches(lower(failure_text), 'failure|fail|broken|malfunction')
                                    AND NOT contains(lower(failure_text), 'no failure')) AS DOUBLE)
             * 100.0 / count(*), 6)
FROM t
UNION ALL
SELECT 'fail_code', 'numeric', round(avg(CASE WHEN (user_id * 7 + event_id) % 300 > 200 THEN 1.0 ELSE 0.0 END) * 100.0, 6)
FROM t"""


def type_distribution() -> str:
    return """
SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IS NOT NULL
GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10"""


def numeric_summary() -> str:
    cols = ("event_id", "value", "k", *EVENT_SENSORS)
    parts = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
        f"round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std FROM rd" for c in cols)
    return "WITH " + _ev() + "\n" + parts


def cooldown_events() -> str:
    return "WITH RECURSIVE " + _ev() + """,
c AS (SELECT event_id, equipment_id, "timestamp", failure_imminent FROM rd WHERE degradation_level > 0.5),
st AS (SELECT equipment_id, min("timestamp") + INTERVAL 1 DAY AS probe FROM rd GROUP BY equipment_id),
first_e AS (SELECT arg_min(b.event_id, b."timestamp") AS event_id FROM st JOIN c b
            ON st.equipment_id = b.equipment_id AND b."timestamp" > st.probe GROUP BY st.equipment_id),
nx AS (SELECT a.event_id, arg_min(b.event_id, b."timestamp") AS nxt FROM c a JOIN c b
       ON a.equipment_id = b.equipment_id AND b."timestamp" > a."timestamp" + INTERVAL 1 DAY
       GROUP BY a.event_id),
chain(event_id) AS (
  SELECT event_id FROM first_e
  UNION ALL
  SELECT nx.nxt FROM chain JOIN nx ON nx.event_id = chain.event_id)
SELECT c.event_id, c.equipment_id, c."timestamp",
       CASE WHEN c.failure_imminent THEN 'corrective' ELSE 'preventive' END AS maintenance_type
FROM chain JOIN c ON c.event_id = chain.event_id"""


def daily_spine_asof() -> str:
    return """
WITH r AS (SELECT event_id, ts AS "timestamp", CAST(user_id AS VARCHAR) AS equipment_id, value FROM events),
rg AS (SELECT equipment_id, min("timestamp") AS a, max("timestamp") AS b FROM r GROUP BY 1),
sp AS (SELECT equipment_id, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS "timestamp" FROM rg)
SELECT sp.equipment_id, sp."timestamp", r.event_id, round(r.value, 6) AS value
FROM sp ASOF LEFT JOIN r ON sp.equipment_id = r.equipment_id AND sp."timestamp" >= r."timestamp\""""


def rolling_features() -> str:
    return """
SELECT event_id, CAST(user_id AS VARCHAR) AS equipment_id,
       round(avg(value) OVER w, 6) AS value_roll_mean,
       round(max(value) OVER w, 6) AS value_roll_max,
       CAST(count(value) OVER w AS BIGINT) AS value_roll_count
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)"""


def degradation_curve() -> str:
    return """
WITH r AS (SELECT event_id, CAST(user_id AS VARCHAR) AS equipment_id,
                  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE)
                    / count(*) OVER (PARTITION BY user_id) AS progress FROM events),
d AS (SELECT *, least(pow(progress / 0.8, 2.0), CAST(1.0 AS DOUBLE)) AS dc FROM r)
SELECT event_id, equipment_id, round(progress, 6) AS progress, round(dc, 6) AS degradation_curve,
       dc > 0.85 AS failing
FROM d"""


def degradation_cmapss() -> str:
    return """
WITH m AS (SELECT l_suppkey, max(l_linenumber) AS mc FROM lineitem GROUP BY 1)
SELECT printf('Engine_%03d', CAST(l.l_suppkey AS INTEGER)) AS equipment_id,
       TIMESTAMP '2023-01-01 00:00:00' + to_hours(CAST(l.l_linenumber AS BIGINT)) AS "timestamp",
       round(l.l_quantity, 6) AS vibration, round(l.l_extendedprice, 6) AS temperature,
       round(l.l_discount, 6) AS pressure, round(l.l_tax, 6) AS current,
       round(CAST(l.l_partkey AS DOUBLE), 6) AS rpm,
       round(CAST(l.l_linenumber AS DOUBLE) / m.mc, 6) AS degradation_level,
       l.l_linenumber > m.mc * 0.9 AS failure_imminent
FROM lineitem l JOIN m USING (l_suppkey)"""


def scaler_apply() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINEITEM_SENSORS)
    cols = ",\n  ".join(
        f"round(({c} - m_{c}) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END), 6) AS {c}"
        for c in LINEITEM_SENSORS)
    return f"""
WITH st AS (SELECT {stats} FROM lineitem)
SELECT l_orderkey, l_linenumber,
  {cols}
FROM lineitem, st"""


def weighted_ensemble() -> str:
    w = (0.35, 0.30, 0.25, 0.10)
    num = " + ".join(f"CAST({x} AS DOUBLE) * {c}" for x, c in zip(w, LINEITEM_SENSORS))
    den = " + ".join(f"CAST({x} AS DOUBLE)" for x in w)
    return f"""
SELECT l_orderkey, l_linenumber, round(({num}) / ({den}), 6) AS ensemble,
       round(greatest(l_discount - 0.05, CAST(0.0 AS DOUBLE)), 6) AS relu_discount
FROM lineitem"""


def split_counts() -> str:
    return """
WITH s AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, 'test' AS split, CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS n FROM s
UNION ALL
SELECT o_orderpriority, 'train' AS split, CAST(n - ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS n FROM s"""


def template_align() -> str:
    feats = [f"{s}_{t}" for s in EVENT_SENSORS for t in ("mean", "std", "max", "min")]
    cols = []
    for f in feats:
        val = "CAST(0.0 AS DOUBLE)"
        for s in EVENT_SENSORS:
            if s in f:
                if any(t in f for t in ("mean", "max", "min", "median")):
                    val = f"coalesce({s}, CAST(0.0 AS DOUBLE))"
                elif any(t in f for t in ("std", "range")):
                    val = "CAST(0.1 AS DOUBLE)"
                else:
                    val = f"coalesce({s}, CAST(0.0 AS DOUBLE))"
        cols.append(f"round({val}, 6) AS {f}")
    return "WITH " + _ev() + "\nSELECT event_id,\n  " + ",\n  ".join(cols) + "\nFROM rd"


def critical_readings() -> str:
    th = (("vibration", 3.06), ("temperature", 314.0), ("pressure", 207.0), ("current", 69.0),
          ("rpm", 2076.0), ("tool_wear", 298.0))
    longs = "\nUNION ALL\n".join(
        f"SELECT event_id, equipment_id, '{c}' AS sensor, {c} AS value, CAST({t} AS DOUBLE) AS threshold FROM rd"
        for c, t in th)
    return "WITH " + _ev() + f""",
lg AS ({longs})
SELECT sensor, event_id, equipment_id, round(value, 6) AS value, round(threshold, 6) AS threshold
FROM lg WHERE value > threshold"""


def sensor_bands() -> str:
    bands = (("vibration", 3.01, 3.04, 3.06), ("temperature", 312.0, 314.0, 314.0),
             ("pressure", 180.0, 207.0, 207.0), ("current", 55.0, 69.0, 69.0),
             ("rpm", 1800.0, 2076.0, 2076.0), ("tool_wear", 200.0, 250.0, 250.0))
    longs = "\nUNION ALL\n".join(
        f"SELECT event_id, equipment_id, '{c}' AS sensor, {c} AS value, "
        f"CASE WHEN {c} > CAST({cr} AS DOUBLE) THEN 'critical' "
        f"WHEN {c} >= CAST({lo} AS DOUBLE) AND {c} <= CAST({hi} AS DOUBLE) THEN 'warning' "
        f"WHEN {c} IS NOT NULL THEN 'normal' END AS band FROM rd"
        for c, lo, hi, cr in bands)
    return "WITH " + _ev() + f""",
lg AS ({longs})
SELECT event_id, equipment_id, sensor, round(value, 6) AS value, band,
       CASE WHEN band = 'critical' THEN '24 hours' ELSE '2-4 weeks' END AS response_target
FROM lg WHERE band <> 'normal'"""


def failure_maintenance() -> str:
    return "WITH " + _ev() + """
SELECT "timestamp", equipment_id, 'corrective' AS maintenance_type, 'Machine failure detected' AS description,
       'tool, bearings' AS parts_replaced, 'Tech_01' AS technician, CAST(8.0 AS DOUBLE) AS downtime_hours
FROM rd WHERE failure_imminent"""


def oracle_sql() -> dict[str, str]:
    return {
        "equipment_features": equipment_features(),
        "fleet_features": fleet_features(),
        "equipment_labels": equipment_labels(),
        "heuristic_labels": heuristic_labels(),
        "simple_features": simple_features(),
        "temperature_trend": temperature_trend(),
        "expected_ranges": expected_ranges(),
        "range_warnings": range_warnings(),
        "critical_readings": critical_readings(),
        "sensor_bands": sensor_bands(),
        "failure_maintenance": failure_maintenance(),
        "asof_enrich": asof_enrich(),
        "interpolate_gaps": interpolate_gaps(),
        "clean_enrich": clean_enrich(),
        "zscore_filter": zscore_filter(),
        "median_impute": median_impute(),
        "null_report": null_report(),
        "batch_health": batch_health(),
        "health_tiers": health_tiers(),
        "risk_matrix": risk_matrix(),
        "prob_histogram": prob_histogram(),
        "fleet_summary": fleet_summary(),
        "fleet_status": fleet_status(),
        "fleet_aggregates": fleet_aggregates(),
        "rule_labels": rule_labels(),
        "prediction_rules": prediction_rules(),
        "sensor_corr": sensor_corr(),
        "sensor_corr_by_equipment": sensor_corr_by_equipment(),
        "urgent_top": urgent_top(),
        "health_trend_daily": health_trend_daily(),
        "alert_digest": alert_digest(),
        "dataset_profile": dataset_profile(),
        "failure_rate": failure_rate(),
        "type_distribution": type_distribution(),
        "numeric_summary": numeric_summary(),
        "cooldown_events": cooldown_events(),
        "daily_spine_asof": daily_spine_asof(),
        "rolling_features": rolling_features(),
        "degradation_curve": degradation_curve(),
        "degradation_cmapss": degradation_cmapss(),
        "scaler_apply": scaler_apply(),
        "weighted_ensemble": weighted_ensemble(),
        "split_counts": split_counts(),
        "template_align": template_align(),
    } | more.oracle_sql() | stored.oracle_sql() | streams.oracle_sql() | whole.oracle_sql()
