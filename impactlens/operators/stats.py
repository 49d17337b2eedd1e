"""Aggregations, ordered previews and batch summaries.

All aggregations are ``groupBy().agg()`` with algebraic aggregates
(count/sum/avg/min/max), so Spark combines map-side before the shuffle: a
policy with a third of all rows still shuffles one partial row per map
task. Sorted previews are ``orderBy().limit(n)``, which plans as a bounded
top-k per task (TakeOrderedAndProject), never a full sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_THRESHOLDS, Thresholds
from ..functions.columns import exact_avg
from ..functions.sqlfuncs import crash_patterns_sql, register_stream_view
from .detect import crash_condition, crash_type, risk_weight_of

# Default preview sizes of the reports: patterns, storage stats, daily counts,
# and the two unsorted samples of written data.
PREVIEW_ROWS = {"patterns": 5, "storage": 10, "daily": 7, "sample": 3, "written": 5}


def with_dates(df: DataFrame, time_col: str = "event_time") -> DataFrame:
    """UTC partition columns derived from event time (strings, as stored)."""
    t = F.col(time_col)
    return df.withColumns({
        "date": F.date_format(t, "yyyy-MM-dd"),
        "hour": F.date_format(t, "HH"),
        "year": F.date_format(t, "yyyy"),
        "month": F.date_format(t, "MM"),
    })


def crash_patterns(spark: SparkSession, df: DataFrame,
                   thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """The SQL crash-pattern analysis over the ``telematics_stream`` view."""
    register_stream_view(spark, df, thr)
    return spark.sql(crash_patterns_sql(thr))


def crash_events(df: DataFrame, profile: str = "batch",
                 thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    return df.filter(crash_condition(profile, thr))


def normal_events(df: DataFrame, profile: str = "batch",
                  thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    return df.filter(~crash_condition(profile, thr))


def driving_stats(df: DataFrame, thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """Per-policy statistics of non-crash (batch profile) telemetry."""
    normal = normal_events(df, "batch", thr).withColumn(
        "risk_weight", risk_weight_of(crash_type("batch", thr)))
    return normal.groupBy("policy_id").agg(
        exact_avg(F.col("speed_mph")).alias("avg_speed"),
        F.max("g_force").alias("max_g_force"),
        F.min("g_force").alias("min_g_force"),
        exact_avg(F.col("risk_weight")).alias("avg_risk_score"),
        F.count(F.lit(1)).alias("message_count"),
    )


def storage_stats(df: DataFrame) -> DataFrame:
    """Per policy and UTC date, newest first, busiest first."""
    return (with_dates(df).groupBy("policy_id", "date")
            .agg(F.count(F.lit(1)).alias("record_count"),
                 exact_avg(F.col("speed_mph")).alias("avg_speed"),
                 F.max("g_force").alias("max_g_force"),
                 F.min("g_force").alias("min_g_force"))
            .orderBy(F.desc("date"), F.desc("record_count"), F.asc_nulls_first("policy_id")))


def daily_counts(df: DataFrame) -> DataFrame:
    return (with_dates(df).groupBy("date").agg(F.count(F.lit(1)).alias("total_records"))
            .orderBy(F.desc("date")))


def preview(df: DataFrame, kind: str, rows: int | None = None) -> DataFrame:
    """Top rows of a sorted result (the sort keys include a tie-break):
    ``rows`` of them, by default as many as the report of that kind shows."""
    return df.limit(PREVIEW_ROWS[kind] if rows is None else rows)


def batch_summary(tagged: DataFrame, thr: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """Counts per batch in one aggregation: rows, good rows, quarantined,
    crashes under each profile, events the SQL analysis reports, distinct
    policies.

    ``tagged`` is enriched telemetry with a ``reason`` column (null = good).
    """
    good = F.col("reason").isNull()
    return tagged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(good).alias("good_rows"),
        F.count_if(~good).alias("quarantined"),
        F.count_if(good & crash_condition("message", thr)).alias("message_crashes"),
        F.count_if(good & crash_condition("batch", thr)).alias("batch_crashes"),
        # The SQL analysis selects by the batch profile's rule.
        F.count_if(good & crash_condition("batch", thr)).alias("risk_events"),
        F.count_distinct(F.when(good, F.col("policy_id"))).alias("policies"),
    )
