"""Cross-checks across a whole table: reported vs derived g, GPS vs
vehicle speed, magnetic-field anomalies against each vehicle's baseline.

Messages without a vin come from vehicles that are not known: they are
reported as one group with a null vin, counted and compared with that
group's mean. No operator needs a message id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_avg, gt


def g_force_reconciliation(df: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Per policy: how often the reported g disagrees with the
    accelerometer-derived g by more than ``tolerance``."""
    diff = F.abs(F.col("g_force") - F.col("total_g_force"))
    return df.groupBy("policy_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(gt(diff, tolerance)).alias("mismatches"),
        (F.count_if(gt(diff, tolerance)) / F.count(F.lit(1))).alias("mismatch_rate"),
        exact_avg(diff).alias("avg_abs_diff"),
    )


def g_force_mismatches(df: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """The messages behind the mismatches of :func:`g_force_reconciliation`."""
    diff = F.abs(F.col("g_force") - F.col("total_g_force"))
    return df.filter(gt(diff, tolerance)).select(
        "message_id", "policy_id", "vin", "g_force", "total_g_force", diff.alias("abs_diff"))


def speed_reconciliation(df: DataFrame, tolerance_mph: float = 5.0) -> DataFrame:
    """Per policy: GPS speed (converted to mph) against the vehicle speed,
    over messages that carry a GPS speed."""
    diff = F.abs(F.col("gps_speed_mph") - F.col("speed_mph"))
    fixes = df.filter(F.col("has_gps") & F.col("gps_speed").isNotNull())
    return fixes.groupBy("policy_id").agg(
        F.count(F.lit(1)).alias("fixes"),
        F.count_if(gt(diff, tolerance_mph)).alias("mismatches"),
        exact_avg(diff).alias("avg_abs_diff_mph"),
        F.max(diff).alias("max_abs_diff_mph"),
    )


def magnetic_anomalies(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Messages whose field magnitude deviates from the vehicle's mean
    magnitude by more than ``threshold``.

    The baseline is a partial-then-final aggregate (one row per vehicle)
    joined back on the null-safe vin. Spark broadcasts it where its measured
    size allows; otherwise both sides of the sort-merge join are plain
    exchanges, so adaptive execution splits a vehicle that holds a large share
    of the messages without copying any other vehicle's baseline.
    """
    rows = df.filter(F.col("has_magnetometer"))
    base = rows.groupBy(F.col("vin").alias("base_vin")).agg(
        exact_avg(F.col("mag_magnitude")).alias("baseline_magnitude"))
    dev = F.abs(F.col("mag_magnitude") - F.col("baseline_magnitude"))
    return (rows.select("message_id", "vin", "mag_magnitude")
            .join(base, F.col("vin").eqNullSafe(F.col("base_vin"))).drop("base_vin")
            .withColumn("deviation", dev)
            .filter(gt(F.col("deviation"), threshold)))
