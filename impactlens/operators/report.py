"""Crash reports and alert rows.

A report is built from the crash row itself (no lookup back into the batch
by policy id, which would hand two crashes of one policy the same sensors).
A crash whose report cannot be built (no policy id, GPS or magnetometer)
is not dropped: it comes back in the second frame with a ``reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_THRESHOLDS, Thresholds
from ..functions.cache import session_cached
from ..functions.columns import gt, lit_d, report_id
from ..schema import CRASH_REPORT
from .detect import emergency, report_inputs, severity_level

REPORT_COLUMNS = [f.name for f in CRASH_REPORT.fields]


def deceleration_rate(g: Column, speed: Column, thr: Thresholds = DEFAULT_THRESHOLDS) -> Column:
    return F.when(gt(g, thr.sudden_stop_g), speed * (g / lit_d(4.0))).otherwise(lit_d(0.0))


def unbuildable_reason() -> Column:
    return (F.when(F.col("policy_id").isNull(), F.lit("report_missing_policy_id"))
            .when(~F.col("has_gps"), F.lit("report_missing_gps"))
            .when(~F.col("has_magnetometer"), F.lit("report_missing_magnetometer")))


def crash_reports(df: DataFrame, profile: str = "message", keep: tuple[str, ...] = ("message_id",),
                  thr: Thresholds = DEFAULT_THRESHOLDS) -> tuple[DataFrame, DataFrame]:
    """(reports, unbuildable) from an analysed frame (see ``detect.analyse``).

    ``reports`` has the nested report columns plus ``keep``; both frames
    are narrow filters/projections of ``df``.
    """
    crashes = df.filter(F.col("is_crash")).withColumn("reason", unbuildable_reason())
    ok = crashes.filter(F.col("reason").isNull())
    unbuildable = crashes.filter(F.col("reason").isNotNull())
    return ok.select(*_report_columns(profile, tuple(keep), thr)), unbuildable


@session_cached
def _report_columns(profile: str, keep: tuple, thr: Thresholds) -> list:
    ctype, risk, total = report_inputs(profile)
    g, speed = F.col("g_force"), F.col("speed_mph")
    ax, ay, az = (F.col(f"acc_{a}") for a in "xyz")
    gx, gy, gz = (F.col(f"gyro_{a}") for a in "xyz")
    mx, my, mz = (F.col(f"mag_{a}") for a in "xyz")
    lat, lon = F.col("gps_lat"), F.col("gps_lon")
    hdg, lateral, vertical = F.col("heading"), F.col("lateral_g_force"), F.col("vertical_g_force")
    gyro_mag = F.col("gyro_magnitude")

    def vector() -> Column:
        return F.struct(ax.alias("x"), ay.alias("y"), az.alias("z"), total.alias("magnitude"))

    return [
        report_id(F.col("policy_id"), F.col("event_time")).alias("report_id"),
        "policy_id", "vin",
        F.col("timestamp").alias("crash_timestamp"),
        ctype.alias("crash_type"),
        severity_level(g, total, risk).alias("severity_level"),
        F.struct(total.alias("total_g_force"), lateral.alias("lateral_g_force"),
                 vertical.alias("vertical_g_force"), speed.alias("speed_at_impact"),
                 vector().alias("acceleration_vector"),
                 deceleration_rate(g, speed, thr).alias("deceleration_rate")).alias("impact_details"),
        F.struct(lat.alias("latitude"), lon.alias("longitude"), F.col("current_street"),
                 hdg.alias("heading"),
                 F.lit(None).cast("double").alias("accuracy_meters")).alias("location"),
        F.struct(F.col("vin"), speed.alias("speed_mph"), hdg.alias("heading")).alias("vehicle_data"),
        F.struct(
            F.struct(vector().alias("raw_values"), total.alias("total_magnitude"),
                     lateral.alias("lateral_magnitude"),
                     vertical.alias("vertical_magnitude")).alias("accelerometer"),
            F.struct(gx.alias("x"), gy.alias("y"), gz.alias("z"), gyro_mag.alias("magnitude"),
                     (gt(F.abs(gy), thr.rollover) | gt(gyro_mag, thr.rollover)).alias("indicates_rollover"),
                     gt(F.abs(gz), thr.spinning).alias("indicates_spinning")).alias("gyroscope"),
            F.struct(mx.alias("x"), my.alias("y"), mz.alias("z"),
                     hdg.alias("heading_degrees")).alias("magnetometer"),
            F.col("rollover").alias("rollover_detected"),
            F.col("spinning").alias("spinning_detected")).alias("sensor_analysis"),
        emergency(g, risk).alias("emergency_recommended"),
        risk.alias("risk_score"),
        total.alias("total_g_force"),
        F.current_timestamp().alias("processed_timestamp"),
        *[F.col(k) for k in keep],
    ]


def flatten(df: DataFrame, sep: str = "_", prefix: str = "") -> list[Column]:
    """Leaf columns of nested structs, named by their path joined with ``sep``."""
    out: list[Column] = []

    def walk(dtype, path: list[str]) -> None:
        from pyspark.sql.types import StructType
        if isinstance(dtype, StructType):
            for f in dtype.fields:
                walk(f.dataType, path + [f.name])
        else:
            out.append(F.col(".".join(f"`{p}`" for p in path)).alias(prefix + sep.join(path)))

    for f in df.schema.fields:
        walk(f.dataType, [f.name])
    return out


def crash_alerts(df: DataFrame) -> DataFrame:
    """One wide row per crash with everything the alert reports."""
    crashes = df.filter(F.col("is_crash"))
    p = F.col("pressure")
    dev = F.col("has_device")
    return crashes.select(
        "message_id", "crash_type", "policy_id", "vin", "timestamp", "current_street",
        F.col("gps_lat").alias("latitude"), F.col("gps_lon").alias("longitude"),
        F.col("gps_accuracy").alias("accuracy"),
        F.col("gps_satellites").alias("satellite_count"),
        "gps_quality",
        F.col("gps_altitude").alias("altitude"), F.col("gps_bearing").alias("bearing"),
        "cardinal_direction", "speed_mph", "g_force", "lateral_g_force", "vertical_g_force",
        F.col("acc_x").alias("accel_x"), F.col("acc_y").alias("accel_y"),
        F.col("acc_z").alias("accel_z"),
        F.col("gyro_x").alias("pitch"), F.col("gyro_y").alias("roll"), F.col("gyro_z").alias("yaw"),
        "motion_type", "gyro_magnitude", "heading",
        p.alias("barometric_pressure"),
        F.when(p.isNotNull(), F.col("estimated_altitude_m")).alias("estimated_altitude_m"),
        "weather_event", "high_altitude",
        "device_health_status",
        F.when(dev, F.col("battery_percentage")).alias("battery_percentage"),
        "signal_quality", "orientation",
        F.when(dev, F.col("screen_active")).alias("screen_active"),
        F.when(dev, F.col("is_charging")).alias("charging"),
        (F.when(F.col("critical_battery"), F.lit("CRITICAL_BATTERY"))
         .when(F.col("low_battery"), F.lit("LOW_BATTERY"))).alias("battery_warning"),
        "weak_signal", "rollover", "spinning",
    )
