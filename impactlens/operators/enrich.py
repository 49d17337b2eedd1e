"""Enrichment projections (motion, heading, GPS quality, environment,
device health).

Each job is a pure projection over the canonical telemetry frame, so it
adds no shuffle and stays in the same whole-stage-codegen span as the
scan. Columns a later query does not select are pruned by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_THRESHOLDS, MS_TO_MPH, Thresholds
from ..functions.cache import session_cached
from ..functions.columns import (baro_altitude, cardinal, ge, gt, heading_from_field,
                                 int_truncate, lateral_g, lit_d, magnitude, total_g,
                                 vertical_g)

# Flat copies of the sensor leaves, projected once at the start of the
# enrichment. Derived columns reference these attributes (several times
# each), which keeps Catalyst from inlining an expensive producer of the
# nested struct (JSON coercion, derived fixtures) at every field access.
LEAVES = {
    "acc_x": "sensors.accelerometer.x", "acc_y": "sensors.accelerometer.y",
    "acc_z": "sensors.accelerometer.z",
    "gyro_x": "sensors.gyroscope.x", "gyro_y": "sensors.gyroscope.y",
    "gyro_z": "sensors.gyroscope.z",
    "mag_x": "sensors.magnetometer.x", "mag_y": "sensors.magnetometer.y",
    "mag_z": "sensors.magnetometer.z", "mag_heading": "sensors.magnetometer.heading",
    "gps_lat": "sensors.gps.lat", "gps_lon": "sensors.gps.lon",
    "gps_altitude": "sensors.gps.altitude", "gps_speed": "sensors.gps.speed",
    "gps_bearing": "sensors.gps.bearing", "gps_accuracy": "sensors.gps.accuracy",
    "gps_satellites": "sensors.gps.satellite_count", "gps_fix_time": "sensors.gps.fix_time",
    "pressure": "sensors.barometric_pressure",
    "battery_level": "sensors.device.battery_level",
    "signal_strength": "sensors.device.signal_strength",
    "orientation": "sensors.device.device_orientation",
    "screen_on": "sensors.device.screen_on", "charging": "sensors.device.charging",
}
PRESENCE = {"has_gps": "sensors.gps", "has_magnetometer": "sensors.magnetometer",
            "has_device": "sensors.device"}


def with_leaves(df: DataFrame, names=None) -> DataFrame:
    """Adds the flat sensor leaves (idempotent); ``names`` limits which."""
    want = set(names) if names is not None else set(LEAVES) | set(PRESENCE)
    cols = {k: c for k, c in _leaf_columns().items() if k in want and k not in df.columns}
    return df.withColumns(cols) if cols else df


@session_cached
def _leaf_columns() -> dict:
    cols = {k: F.col(v) for k, v in LEAVES.items()}
    cols.update({k: F.col(v).isNotNull() for k, v in PRESENCE.items()})
    return cols


def _apply(df: DataFrame, layers: list[dict]) -> DataFrame:
    for layer in layers:
        df = df.withColumns(layer)
    return df


@session_cached
def _motion_layers(thr: Thresholds) -> list[dict]:
    ax, ay, az = (F.col(f"acc_{a}") for a in "xyz")
    pitch, roll, yaw = (F.col(f"gyro_{a}") for a in "xyz")
    mag = F.col("gyro_magnitude")
    return [{
        "total_g_force": total_g(ax, ay, az),
        "lateral_g_force": lateral_g(ax, ay),
        "vertical_g_force": vertical_g(az),
        "gyro_magnitude": magnitude(pitch, roll, yaw),
    }, {
        "rollover": gt(F.abs(roll), thr.rollover) | gt(mag, thr.rollover),
        "spinning": gt(F.abs(yaw), thr.spinning),
        "pitching": gt(F.abs(pitch), thr.pitching),
        "motion_type": (F.when(gt(F.abs(roll), thr.rollover), F.lit("ROLLING"))
                        .when(gt(F.abs(yaw), thr.spinning), F.lit("SPINNING"))
                        .when(gt(F.abs(pitch), thr.pitching), F.lit("PITCHING"))
                        .when(gt(mag, thr.unstable), F.lit("UNSTABLE"))
                        .otherwise(F.lit("STABLE"))),
    }]


def motion(df: DataFrame, thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    return _apply(with_leaves(df), _motion_layers(thr))


@session_cached
def _heading_layers() -> list[dict]:
    mx, my, mz = (F.col(f"mag_{a}") for a in "xyz")
    provided = F.col("mag_heading")
    present = F.col("has_magnetometer")
    return [{
        "heading_computed": heading_from_field(mx, my),
        "has_heading": present & provided.isNotNull(),
        "mag_magnitude": magnitude(mx, my, mz),
    }, {
        "heading": F.when(present, F.coalesce(provided, F.col("heading_computed"))),
    }, {
        "cardinal_direction": cardinal(F.col("heading")),
    }]


def heading(df: DataFrame) -> DataFrame:
    return _apply(with_leaves(df), _heading_layers())


@session_cached
def _gps_layers(thr: Thresholds) -> list[dict]:
    present = F.col("has_gps")
    acc, sats, alt, spd = (F.col(c) for c in
                           ("gps_accuracy", "gps_satellites", "gps_altitude", "gps_speed"))
    ha, gs = F.col("high_accuracy"), F.col("good_satellites")
    return [{
        "gps_speed_mph": F.when(present, F.coalesce(spd * lit_d(MS_TO_MPH), lit_d(0.0))),
        "high_accuracy": F.coalesce(acc <= lit_d(thr.accuracy_m), F.lit(False)),
        "good_satellites": F.coalesce(sats >= thr.min_satellites, F.lit(False)),
        "gps_high_altitude": F.coalesce(gt(alt, thr.gps_high_altitude_m), F.lit(False)),
    }, {
        "gps_quality": (F.when(~present, F.lit(None).cast("string"))
                        .when(~gs, F.lit("POOR")).when(~ha, F.lit("MODERATE"))
                        .otherwise(F.lit("EXCELLENT"))),
        "gps_reliable": F.when(~present, F.lit(True)).otherwise(ha & gs),
    }]


def gps_quality(df: DataFrame, thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    return _apply(with_leaves(df), _gps_layers(thr))


@session_cached
def _environment_layers(thr: Thresholds) -> list[dict]:
    p = F.col("pressure")
    return [{
        "weather_event": F.coalesce((p < lit_d(thr.weather_low_hpa))
                                    | gt(p, lit_d(thr.weather_high_hpa)), F.lit(False)),
        "high_altitude": F.coalesce(p < lit_d(thr.high_altitude_hpa), F.lit(False)),
        "estimated_altitude_m": baro_altitude(p),
    }, {
        "environmental_risk": F.col("weather_event") | F.col("high_altitude"),
    }]


def environment(df: DataFrame, thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    return _apply(with_leaves(df), _environment_layers(thr))


@session_cached
def _device_layers(thr: Thresholds) -> list[dict]:
    present = F.col("has_device")
    bl, sig, ori = (F.col(c) for c in ("battery_level", "signal_strength", "orientation"))
    low, crit, weak, chg = (F.col(c) for c in
                            ("low_battery", "critical_battery", "weak_signal", "is_charging"))
    none = F.lit(None).cast("string")
    return [{
        "low_battery": F.coalesce(bl < lit_d(thr.low_battery), F.lit(False)),
        "critical_battery": F.coalesce(bl < lit_d(thr.critical_battery), F.lit(False)),
        "weak_signal": F.coalesce(sig < thr.weak_signal_dbm, F.lit(False)),
        "battery_percentage": F.when(present,
                                     F.when(bl.isNull(), F.lit(0)).otherwise(int_truncate(bl))),
        "portrait": F.coalesce(F.lower(ori) == "portrait", F.lit(False)),
        "landscape": F.coalesce(F.lower(ori) == "landscape", F.lit(False)),
        "screen_active": F.coalesce(F.col("screen_on"), F.lit(False)),
        "is_charging": F.coalesce(F.col("charging"), F.lit(False)),
    }, {
        "device_issues": low | weak,
        "device_health_status": (F.when(~present, none)
                                 .when(crit & ~chg, F.lit("CRITICAL_BATTERY"))
                                 .when(low & ~chg, F.lit("LOW_BATTERY"))
                                 .when(weak, F.lit("WEAK_SIGNAL"))
                                 .otherwise(F.lit("HEALTHY"))),
        "signal_quality": (F.when(~present, none).when(sig.isNull(), F.lit("UNKNOWN"))
                           .when(sig >= -50, F.lit("EXCELLENT")).when(sig >= -60, F.lit("GOOD"))
                           .when(sig >= -70, F.lit("FAIR")).when(sig >= -80, F.lit("POOR"))
                           .otherwise(F.lit("VERY_POOR"))),
    }]


def device_health(df: DataFrame, thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    return _apply(with_leaves(df), _device_layers(thr))


def enrich(df: DataFrame, thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """All five enrichment jobs, in dependency order."""
    df = with_leaves(df)
    for layers in (_motion_layers(thr), _heading_layers(), _gps_layers(thr),
                   _environment_layers(thr), _device_layers(thr)):
        df = _apply(df, layers)
    return df


__all__ = ["motion", "heading", "gps_quality", "environment", "device_health", "enrich", "ge"]
