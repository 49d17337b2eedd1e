"""Crash detection, classification, scoring and severity.

Two rule profiles exist and disagree on purpose:

* ``message`` - judged per message from the *reported* ``g_force`` with an
  adaptive threshold (bad weather lowers it, unreliable data raises it);
  rollover and spinning use strict ``>``.
* ``batch`` - judged from the accelerometer-derived ``total_g_force``, no
  adaptive threshold, rollover is ``gyro_magnitude >= 3`` and spinning
  only classifies, it never makes a row a crash.

All functions expect an :func:`~impactlens.operators.enrich.enrich`-ed frame
and add columns; none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_THRESHOLDS, RISK_WEIGHT_DEFAULT, RISK_WEIGHTS, Thresholds
from ..functions.cache import session_cached
from ..functions.columns import ge, gt, lit_d
from ..functions.sqlfuncs import risk_category_sql

PROFILES = ("message", "batch")


def _check(profile: str) -> None:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; expected one of {PROFILES}")


@session_cached
def adjusted_threshold(thr: Thresholds = DEFAULT_THRESHOLDS) -> Column:
    """Message-profile g threshold, multiplied in rule order."""
    base = lit_d(thr.g_force)
    unreliable = F.col("device_issues") | ~F.col("gps_reliable")
    return (base * F.when(F.col("environmental_risk"), lit_d(thr.weather_factor)).otherwise(lit_d(1.0))
            * F.when(unreliable, lit_d(thr.unreliable_factor)).otherwise(lit_d(1.0)))


def _g(profile: str) -> Column:
    return F.col("g_force") if profile == "message" else F.col("total_g_force")


@session_cached
def crash_condition(profile: str = "message", thr: Thresholds = DEFAULT_THRESHOLDS) -> Column:
    _check(profile)
    g, speed = _g(profile), F.col("speed_mph")
    sudden = (speed <= lit_d(thr.speed)) & ge(g, thr.sudden_stop_g)
    side = ge(F.col("lateral_g_force"), thr.lateral)
    vert = ge(F.col("vertical_g_force"), thr.vertical)
    if profile == "message":
        return (ge(g, F.col("g_threshold")) | sudden | F.col("rollover") | F.col("spinning")
                | side | vert)
    return ge(g, thr.g_force) | sudden | ge(F.col("gyro_magnitude"), thr.rollover) | side | vert


@session_cached
def crash_type(profile: str = "message", thr: Thresholds = DEFAULT_THRESHOLDS) -> Column:
    _check(profile)
    g, speed = _g(profile), F.col("speed_mph")
    if profile == "message":
        first = F.when(F.col("rollover"), F.lit("ROLLOVER")).when(F.col("spinning"), F.lit("SPINNING"))
    else:
        yaw = F.col("gyro_z")
        first = (F.when(ge(F.col("gyro_magnitude"), thr.rollover), F.lit("ROLLOVER"))
                 .when(ge(F.abs(yaw), thr.spinning), F.lit("SPINNING")))
    return (first.when(ge(F.col("lateral_g_force"), thr.lateral), F.lit("SIDE_IMPACT"))
            .when(ge(F.col("vertical_g_force"), thr.vertical), F.lit("VERTICAL_IMPACT"))
            .when((speed <= lit_d(thr.speed)) & ge(g, thr.sudden_stop_g), F.lit("SUDDEN_STOP"))
            .when(ge(g, thr.g_force), F.lit("HIGH_G_FORCE"))
            .otherwise(F.lit("UNKNOWN")))


def detect(df: DataFrame, profile: str = "message",
           thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """Adds ``is_crash`` and ``crash_type`` (and ``g_threshold`` for the
    message profile)."""
    _check(profile)
    if profile == "message":
        df = df.withColumn("g_threshold", adjusted_threshold(thr))
    return df.withColumns({"is_crash": crash_condition(profile, thr),
                           "crash_type": crash_type(profile, thr)})


def risk_score(df: DataFrame, thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """0..100 score from the reported g, multiplied in rule order, capped.

    Each rule contributes a factor of ``f`` or exactly ``1.0``; multiplying
    by 1.0 is exact in IEEE arithmetic, so the product equals applying only
    the matching factors in order, without nesting the running score in
    both branches of a conditional (which would double the expression per
    rule).
    """
    return df.withColumn("risk_score", _risk_score_column(thr))


@session_cached
def _risk_score_column(thr: Thresholds) -> Column:
    s = F.col("g_force") * lit_d(10.0)
    factors = [
        (F.col("rollover"), 1.5), (F.col("spinning"), 1.3),
        (ge(F.col("lateral_g_force"), thr.lateral), 1.2),
        (ge(F.col("vertical_g_force"), thr.vertical), 1.1),
        (F.col("weather_event"), 1.2), (F.col("high_altitude"), 1.1),
        (F.col("low_battery"), 0.9), (F.col("weak_signal"), 0.9),
    ]
    for cond, f in factors:
        s = s * F.when(cond, lit_d(f)).otherwise(lit_d(1.0))
    # least() skips nulls (least(null, 100) = 100): cap only real numbers.
    return F.when(s.isNull() | F.isnan(s), s).otherwise(F.least(s, lit_d(100.0)))


def risk_weight_of(type_col: Column) -> Column:
    expr = None
    for name, w in RISK_WEIGHTS:
        expr = (F.when if expr is None else expr.when)(type_col == name, lit_d(w))
    return expr.otherwise(lit_d(RISK_WEIGHT_DEFAULT))


def risk_weight(df: DataFrame, thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """0..1 weight of the batch-profile crash type."""
    return df.withColumn("risk_weight", _risk_weight_column(thr))


@session_cached
def _risk_weight_column(thr: Thresholds) -> Column:
    return risk_weight_of(crash_type("batch", thr))


def classify(df: DataFrame, profile: str = "message",
             thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """Adds only ``crash_type`` for the profile (first matching rule)."""
    return df.withColumn("crash_type", crash_type(profile, thr))


def risk_category(df: DataFrame, thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """Adds ``risk_category`` (rollover / spinning / side impact / normal)."""
    return df.withColumn("risk_category", risk_category_column(thr))


@session_cached
def risk_category_column(thr: Thresholds = DEFAULT_THRESHOLDS) -> Column:
    return F.expr(risk_category_sql("gyro_magnitude", "gyro_z", "lateral_g_force", thr))


def triage(df: DataFrame, thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """Re-types crashes from the reported g (strict limits) and ranks them."""
    return df.withColumns(_triage_columns(thr))


def triage_queue(df: DataFrame, thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """Crashes (``is_crash``) as triage hands them on: most severe first, then
    by reported g; the message id breaks ties where there is one."""
    out = triage(df.filter(F.col("is_crash")), thr)
    return out.orderBy("severity_priority", F.desc("g_force"), "message_id")


@session_cached
def _triage_columns(thr: Thresholds) -> dict:
    g, speed = F.col("g_force"), F.col("speed_mph")
    return {
        "triage_type": (F.when(gt(g, 8.0), F.lit("SEVERE_IMPACT"))
                        .when(gt(g, thr.g_force), F.lit("HIGH_G_FORCE"))
                        .when((speed < lit_d(thr.speed)) & gt(g, thr.sudden_stop_g),
                              F.lit("SUDDEN_STOP"))
                        .otherwise(F.lit("UNKNOWN"))),
        "severity_priority": (F.when(gt(g, 8.0), F.lit(1)).when(gt(g, 6.0), F.lit(2))
                              .when(gt(g, 4.0), F.lit(3)).otherwise(F.lit(4))),
    }


def severity_level(g: Column, total: Column, risk: Column) -> Column:
    return (F.when(ge(g, 8.0) | ge(total, 10.0) | ge(risk, 0.9), F.lit("CRITICAL"))
            .when(ge(g, 6.0) | ge(total, 7.0) | ge(risk, 0.7), F.lit("HIGH"))
            .when(ge(g, 4.0) | ge(total, 5.0) | ge(risk, 0.5), F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))


def emergency(g: Column, risk: Column) -> Column:
    return ge(risk, 0.8) | ge(g, 6.0)


def report_inputs(profile: str) -> tuple[Column, Column, Column]:
    """(crash_type, risk, total_g) a report is built from in each profile.

    The message profile passes its own type, the 0..100 risk score and the
    reported g as "total"; the batch profile passes the triage type, the
    0..1 risk weight and the derived total g. Severity therefore reads a
    0..100 score against 0..1 cut-offs on the message profile, which makes
    nearly every message-profile crash CRITICAL; that is the rule.
    """
    _check(profile)
    if profile == "message":
        return F.col("crash_type"), F.col("risk_score"), F.col("g_force")
    return F.col("triage_type"), F.col("risk_weight"), F.col("total_g_force")


def severity(df: DataFrame, profile: str = "message") -> DataFrame:
    return df.withColumns(_severity_columns(profile))


@session_cached
def _severity_columns(profile: str) -> dict:
    _, risk, total = report_inputs(profile)
    return {
        "severity_level": severity_level(F.col("g_force"), total, risk),
        "emergency_recommended": emergency(F.col("g_force"), risk),
    }


def analyse(df: DataFrame, profile: str = "message",
            thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """enrich -> detect -> score -> severity for one profile."""
    from .enrich import enrich

    out = detect(enrich(df, thr), profile, thr)
    if profile == "message":
        out = risk_score(out, thr)
    else:
        out = triage(risk_weight(out, thr), thr)
    return severity(out, profile)
