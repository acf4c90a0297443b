"""Business rules as pure ``Column -> Column`` expressions.

Every rule here is a ``CASE`` chain or arithmetic on built-in functions, so it
stays inside whole-stage codegen and works identically in batch and streaming
plans.  Strings, cut-offs and weights are fixed values that must equal the
reference's for identical results; they are listed together below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's) ------------------------------
RUL_CAP_HOURS = 10000.0
PROB_CAP = 0.95
CONFIDENCE_STEPS = ((500.0, 0.85), (100.0, 0.75))
CONFIDENCE_FLOOR = 0.65
REC_CRITICAL = "CRITICAL: Schedule immediate maintenance"
REC_HIGH = "HIGH: Schedule maintenance within 1 week"
REC_MEDIUM = "MEDIUM: Plan maintenance within 1 month"
REC_LOW = "LOW: Continue monitoring"
HEALTH_TIERS = (("Excellent", 80.0), ("Good", 60.0), ("Fair", 40.0))
HEALTH_TIER_FLOOR = "Poor"
HEALTH_TIER_LABELS = {
    "Excellent": "Excellent (80-100)",
    "Good": "Good (60-79)",
    "Fair": "Fair (40-59)",
    "Poor": "Poor (0-39)",
}
HEALTH_TIER_ORDER = ("Excellent", "Good", "Fair", "Poor")
# batch heuristic: nominal point and weights
NOMINAL_VIBRATION = 3.0
NOMINAL_TEMPERATURE = 310.0
NOMINAL_PRESSURE = 150.0
HEALTH_WEIGHTS = {"vibration": 1000.0, "temperature": 2.0, "pressure": 0.5, "tool_wear": 0.1}
PROB_WEIGHTS = {"vibration": 10.0, "temperature": 0.05, "tool_wear": 0.003}
BATCH_RUL_BASE = 500.0
BATCH_RUL_WEAR_RATE = 2.0
PRIORITY_CUTS = ((0.7, 40.0, "high"), (0.3, 60.0, "medium"))
PRIORITY_FLOOR = "low"
DECISIONS = {"high": "IMMEDIATE_MAINTENANCE", "medium": "SCHEDULE_MAINTENANCE",
             "low": "CONTINUE_MONITORING"}
URGENCY_LABELS = {"low": "Low", "medium": "Medium"}
URGENCY_OTHER = "High"
COST_HIGH_RISK = 2500
COST_MEDIUM_PRIORITY = 1000
HIGH_RISK_PROB = 0.7
# gauge ranges per sensor (min, max); zones at 60 % / 80 %, alarm line at 90 %
GAUGE_RANGES = {
    "vibration": (2.94, 3.06),
    "temperature": (305.0, 314.0),
    "pressure": (100.0, 207.0),
    "current": (10.0, 69.0),
    "rpm": (1000.0, 2076.0),
    "tool_wear": (0.0, 298.0),
}
# critical thresholds (value above → critical)
CRITICAL_THRESHOLDS = {
    "vibration": 3.06,
    "temperature": 314.0,
    "pressure": 207.0,
    "current": 69.0,
    "rpm": 2076.0,
    "tool_wear": 298.0,
}
# user alert thresholds (settings page defaults)
ALERT_THRESHOLDS = {"temperature": 314.0, "vibration": 3.06, "tool_wear": 250.0}
# six-level health scale (documentation)
HEALTH_SCALE_6 = ((90.0, "Excellent"), (80.0, "Good"), (70.0, "Fair"), (60.0, "Watch"),
                  (40.0, "Poor"))
HEALTH_SCALE_6_FLOOR = "Critical"
# documented bands per sensor: (warning low, warning high, critical above)
SENSOR_BANDS = {
    "vibration": (3.01, 3.04, 3.06),
    "temperature": (312.0, 314.0, 314.0),
    "pressure": (180.0, 207.0, 207.0),
    "current": (55.0, 69.0, 69.0),
    "rpm": (1800.0, 2076.0, 2076.0),
    "tool_wear": (200.0, 250.0, 250.0),
}
# response-time targets per alert severity
RESPONSE_TARGETS = (("critical", "24 hours"), ("high", "1 week"), ("medium", "2-4 weeks"),
                    ("low", "Next scheduled maintenance"))
ACTION_PLANS = (
    (80.0, "Normal Operation"),
    (60.0, "Monitoring Required"),
    (40.0, "Immediate Attention Needed"),
)
ACTION_PLAN_FLOOR = "Emergency Shutdown Recommended"
ACTION_LINES = {
    "Normal Operation": ("Continue routine monitoring", "Next comprehensive check in 30 days", "No immediate action required"),
    "Monitoring Required": ("Increase monitoring frequency to weekly", "Schedule maintenance within 2-4 weeks",
                            "Check specific components identified in analysis"),
    "Immediate Attention Needed": ("Schedule maintenance within 1 week", "Prepare replacement parts if needed",
                                   "Increase monitoring to daily", "Consider reducing equipment load"),
    "Emergency Shutdown Recommended": ("Stop equipment immediately if safe to do so", "Notify maintenance team urgently",
                                       "Prepare for emergency repair", "Investigate root cause after stabilization"),
}
# recommendation: (probability above, RUL hours below, text), first match wins
RECOMMENDATION_STEPS = ((0.8, 24, REC_CRITICAL), (0.6, 168, REC_HIGH), (0.3, 720, REC_MEDIUM))
# risk by probability above, impact by health below
RISK_STEPS, RISK_FLOOR = ((0.7, "High"), (0.3, "Medium")), "Low"
IMPACT_STEPS, IMPACT_FLOOR = ((40, "High"), (60, "Medium")), "Low"
# RUL band by days above; grid status by health above; gauge zone by share of the range below
RUL_BAND_STEPS, RUL_BAND_NONE, RUL_BAND_FLOOR = ((30, "green"), (7, "orange")), "IMMEDIATE", "red"
GRID_STEPS, GRID_FLOOR = ((80, "green"), (60, "yellow"), (40, "orange")), "red"
GAUGE_STEPS, GAUGE_FLOOR, GAUGE_ALARM_SHARE = ((0.6, "normal"), (0.8, "warning")), "critical", 0.9
CARD_IMMEDIATE = "IMMEDIATE ACTION REQUIRED"
CARD_SCHEDULE = "SCHEDULE MAINTENANCE"
CARD_NORMAL = "OPERATING NORMALLY"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _steps(steps: list[tuple[Column, str]], floor: str) -> Column:
    """CASE chain: the text of the first condition that holds, else ``floor``."""
    expr = F
    for cond, text in steps:
        expr = expr.when(cond, F.lit(text))
    return expr.otherwise(F.lit(floor))


def clamp_rul(rul, clamp: bool = True) -> Column:
    """NULL/NaN → 0, else clamp to [0, 10000] (``clamp=False``: root variant)."""
    r = _c(rul)
    missing = r.isNull() | F.isnan(r)
    if not clamp:
        return F.when(missing, F.lit(0.0)).otherwise(r.cast("double"))
    return F.when(missing, F.lit(0.0)).otherwise(
        F.least(F.greatest(r.cast("double"), F.lit(0.0)), F.lit(RUL_CAP_HOURS)))


def probability_from_rul(rul, risk: str = "reference") -> Column:
    """min(rul/1000, .95) when rul > 0, else .95 — longer life gives *higher*
    probability, as in the reference.  ``risk='inverse'``: min(max(1 - rul/1000, 0), .95)."""
    r = _c(rul)
    if risk == "inverse":
        return F.least(F.greatest(1.0 - r / 1000.0, F.lit(0.0)), F.lit(PROB_CAP))
    return F.when(r > 0, F.least(r / 1000.0, F.lit(PROB_CAP))).otherwise(F.lit(PROB_CAP))


def confidence(rul) -> Column:
    """R03."""
    r = _c(rul)
    (t1, c1), (t2, c2) = CONFIDENCE_STEPS
    return F.when(r > t1, F.lit(c1)).when(r > t2, F.lit(c2)).otherwise(F.lit(CONFIDENCE_FLOOR))


def recommendation(rul, prob) -> Column:
    """R04 (LOW is unreachable together with R02; kept as in the reference)."""
    r, p = _c(rul), _c(prob)
    return _steps([((p > above) | (r < below), text) for above, below, text in RECOMMENDATION_STEPS], REC_LOW)


def failure_date(rul, as_of) -> Column:
    """``as_of`` + rul hours (unrounded rul), microsecond precision."""
    base = F.unix_micros(_c(as_of) if not isinstance(as_of, str) else F.to_timestamp(F.lit(as_of)))
    return F.timestamp_micros(base + F.floor(_c(rul) * 3600000000.0).cast("long"))


def default_equipment_id(eid) -> Column:
    """R06."""
    return F.coalesce(_c(eid).cast("string"), F.lit("unknown"))


def health_from_probability(prob) -> Column:
    """R07."""
    return F.greatest(F.lit(0.0), 100.0 - _c(prob) * 100.0)


def health_tier(score, labelled: bool = False) -> Column:
    """>=80 Excellent, >=60 Good, >=40 Fair, else Poor."""
    s = _c(score)
    lab = HEALTH_TIER_LABELS if labelled else {k: k for k in HEALTH_TIER_LABELS}
    expr = None
    for name, cut in HEALTH_TIERS:
        expr = (F.when(s >= cut, F.lit(lab[name])) if expr is None
                else expr.when(s >= cut, F.lit(lab[name])))
    return expr.otherwise(F.lit(lab[HEALTH_TIER_FLOOR]))


def batch_health_score(vibration, temperature, pressure, tool_wear) -> Column:
    """R09 health: NULL in any used input gives 0 (``greatest`` skips the NULL)."""
    penalty = (F.abs(_c(vibration) - NOMINAL_VIBRATION) * HEALTH_WEIGHTS["vibration"]
               + F.abs(_c(temperature) - NOMINAL_TEMPERATURE) * HEALTH_WEIGHTS["temperature"]
               + F.abs(_c(pressure) - NOMINAL_PRESSURE) * HEALTH_WEIGHTS["pressure"]
               + _c(tool_wear) * HEALTH_WEIGHTS["tool_wear"])
    return F.greatest(F.lit(0.0), F.lit(100.0) - penalty)


def batch_failure_probability(vibration, temperature, tool_wear) -> Column:
    """R09 probability: NULL input gives .95 (``least`` skips the NULL)."""
    risk = (F.abs(_c(vibration) - NOMINAL_VIBRATION) * PROB_WEIGHTS["vibration"]
            + F.abs(_c(temperature) - NOMINAL_TEMPERATURE) * PROB_WEIGHTS["temperature"]
            + _c(tool_wear) * PROB_WEIGHTS["tool_wear"])
    return F.least(F.lit(PROB_CAP), risk)


def batch_rul(tool_wear) -> Column:
    """R09 RUL: max(0, 500 - 2 * wear); NULL wear gives 0."""
    return F.greatest(F.lit(0.0), BATCH_RUL_BASE - _c(tool_wear) * BATCH_RUL_WEAR_RATE)


def maintenance_priority(prob, health) -> Column:
    """R10."""
    p, h = _c(prob), _c(health)
    (p1, h1, l1), (p2, h2, l2) = PRIORITY_CUTS
    return (F.when((p > p1) | (h < h1), F.lit(l1))
            .when((p > p2) | (h < h2), F.lit(l2))
            .otherwise(F.lit(PRIORITY_FLOOR)))


def decision(prob, health) -> Column:
    """The R10 cut-offs renamed."""
    pr = maintenance_priority(prob, health)
    return (F.when(pr == "high", F.lit(DECISIONS["high"]))
            .when(pr == "medium", F.lit(DECISIONS["medium"]))
            .otherwise(F.lit(DECISIONS["low"])))


def risk_level(prob) -> Column:
    """R12."""
    return _steps([(_c(prob) > cut, text) for cut, text in RISK_STEPS], RISK_FLOOR)


def impact_level(health) -> Column:
    """R13."""
    return _steps([(_c(health) < cut, text) for cut, text in IMPACT_STEPS], IMPACT_FLOOR)


def urgency_label(priority) -> Column:
    """Low / medium, anything else (including NULL) → High."""
    p = _c(priority)
    return (F.when(p == "low", F.lit(URGENCY_LABELS["low"]))
            .when(p == "medium", F.lit(URGENCY_LABELS["medium"]))
            .otherwise(F.lit(URGENCY_OTHER)))


def days_remaining(rul) -> Column:
    """R15 value: rul / 24."""
    return _c(rul) / 24.0


def rul_band(rul) -> Column:
    """R15 band: IMMEDIATE when rul <= 0, else green (>30 days) / orange (>7 days) / red."""
    r = _c(rul)
    return _steps([(r <= 0, RUL_BAND_NONE), *[(r / 24.0 > days, text) for days, text in RUL_BAND_STEPS]], RUL_BAND_FLOOR)


def grid_status(health) -> Column:
    """Strict cut-offs >80 / >60 / >40 (differs from R08 at the edges)."""
    return _steps([(_c(health) > cut, text) for cut, text in GRID_STEPS], GRID_FLOOR)


def gauge_zone(value, sensor: str) -> Column:
    """Position in [min, max]; <60 % normal, <80 % warning, else alarm zone."""
    lo, hi = GAUGE_RANGES[sensor]
    frac = (_c(value) - lo) / (hi - lo)
    return _steps([(frac < share, text) for share, text in GAUGE_STEPS], GAUGE_FLOOR)


def gauge_alarm(value, sensor: str) -> Column:
    """R17 alarm line at 90 % of the gauge range."""
    lo, hi = GAUGE_RANGES[sensor]
    return _c(value) > lo + (hi - lo) * GAUGE_ALARM_SHARE


def card_class(rec, high_branch: bool = False) -> Column:
    """CRITICAL → immediate, MEDIUM → schedule, else normal (HIGH shows as normal)."""
    r = _c(rec)
    expr = F.when(r.contains("CRITICAL"), F.lit(CARD_IMMEDIATE))
    if high_branch:
        expr = expr.when(r.contains("HIGH"), F.lit(CARD_SCHEDULE))
    return expr.when(r.contains("MEDIUM"), F.lit(CARD_SCHEDULE)).otherwise(F.lit(CARD_NORMAL))


def action_plan(health) -> Column:
    """R19."""
    h = _c(health)
    expr = None
    for cut, text in ACTION_PLANS:
        expr = F.when(h >= cut, F.lit(text)) if expr is None else expr.when(h >= cut, F.lit(text))
    return expr.otherwise(F.lit(ACTION_PLAN_FLOOR))


def action_lines(health) -> Column:
    """The lines of the plan, in order."""
    plan, expr = action_plan(health), F
    for title, lines in ACTION_LINES.items():
        expr = expr.when(plan == title, F.array(*[F.lit(x) for x in lines]))
    return expr.otherwise(F.lit(None))


def health_scale_6(health) -> Column:
    """Documentation scale 90/80/70/60/40."""
    h = _c(health)
    expr = None
    for cut, text in HEALTH_SCALE_6:
        expr = F.when(h >= cut, F.lit(text)) if expr is None else expr.when(h >= cut, F.lit(text))
    return expr.otherwise(F.lit(HEALTH_SCALE_6_FLOOR))


def sensor_band(value, sensor: str) -> Column:
    """R21: 'critical' above the critical level, 'warning' inside the warning band, else 'normal'."""
    lo, hi, crit = SENSOR_BANDS[sensor]
    v = _c(value)
    return (F.when(v > crit, F.lit("critical")).when((v >= lo) & (v <= hi), F.lit("warning"))
            .when(v.isNotNull(), F.lit("normal")))


def response_target(severity) -> Column:
    """Response-time target of an alert severity (critical / high / medium / low)."""
    m = F.create_map(*[x for k, t in RESPONSE_TARGETS for x in (F.lit(k), F.lit(t))])
    return F.element_at(m, F.lower(_c(severity)))


def py_float_text(value) -> Column:
    """Text of a double as Python prints it (``str(float)``), from Spark's own text.

    Both print the shortest round-trip digits; they differ in when they switch to
    exponent form: Spark below 1e-3 and from 1e7 (``1.0E7``), Python below 1e-4 and
    from 1e16 (``1e+16``).  Only the layout is rewritten, with string functions.
    """
    t = _c(value).cast("double").cast("string")
    pat = r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$"
    sign = F.regexp_extract(t, pat, 1)
    frac = F.regexp_extract(t, pat, 3)
    exp = F.regexp_extract(t, pat, 4).cast("int")
    frac = F.when(frac == "0", F.lit("")).otherwise(frac)
    digits = F.concat(F.regexp_extract(t, pat, 2), frac)
    nd = F.length(digits)
    # fixed notation for 1e-4 <= |x| < 1e16
    int_part = F.rpad(F.substring(digits, 1, exp + 1), exp + 1, "0")
    rest = F.when(nd > exp + 1, F.substring(digits, exp + 2, 400)).otherwise(F.lit("0"))
    big = F.concat(sign, int_part, F.lit("."), rest)
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    mant = F.concat(F.regexp_extract(t, pat, 2), F.when(frac == "", F.lit("")).otherwise(
        F.concat(F.lit("."), frac)))
    sci = F.concat(sign, mant, F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
                   F.lpad(F.abs(exp).cast("string"), 2, "0"))
    return (F.when(~t.contains("E"), t)
            .when((exp >= 0) & (exp < 16), big)
            .when((exp < 0) & (exp >= -4), small)
            .otherwise(sci))


def relu(pred) -> Column:
    """Non-negative output."""
    return F.greatest(_c(pred), F.lit(0.0))


def failure_keyword(text) -> Column:
    """lower-case text mentions failure / fail / broken / malfunction and is not 'no failure'."""
    t = F.lower(_c(text).cast("string"))
    return t.rlike("failure|fail|broken|malfunction") & ~t.contains("no failure")
