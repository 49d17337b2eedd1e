"""Distance travelled between consecutive GPS fixes, from summaries that merge.

A summary stands for all fixes of one vehicle in one stretch of time: its first
and last fix, the number of fixes and segments, and the metres, as fixed-point
numbers, so that no result depends on the order of additions. Summaries of
stretches that do not interleave merge by adding the segment between them, in
any grouping. So all fixes are exchanged once, by vehicle and time bucket; then
only summaries travel, to a day and to the vehicle. A vehicle with a large
share of all fixes is spread over its buckets. A bucket is sorted with spilling
and walked once; it is as large as one vehicle's fixes in ``BUCKET_SECONDS``.

Fixes are ordered by event time, then message id, then position. Those without
a vin come from vehicles that are not known: they are counted, in a row with a
null vin, and form no segment. A distance that is no number (a position that is
NaN) makes the vehicle's total NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import haversine_m, lit_d
from .enrich import with_leaves

BUCKET_SECONDS = 600
_DAY_SECONDS = 86_400
_ORDER = ("t", "mid", "lat", "lon")


def fixes_of(df: DataFrame) -> DataFrame:
    """(vin, t, mid, lat, lon) of the messages with a position."""
    return (with_leaves(df, ("gps_lat", "gps_lon", "has_gps")).filter(F.col("has_gps"))
            .select("vin", F.col("event_time").alias("t"), F.col("message_id").alias("mid"),
                    F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon")))


def _lengths(segment: Column) -> dict[str, Column]:
    fixed = segment.try_cast("decimal(28,9)")
    return {"segments": F.count(segment), "metres": F.coalesce(F.sum(fixed), F.lit(0)).cast("decimal(38,9)"),
            "odd": F.count_if(segment.isNotNull() & fixed.isNull()), "longest": F.max(segment)}


def summarise(fixes: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One summary per known vehicle and time bucket of :func:`fixes_of`."""
    bucket = F.floor(F.unix_micros("t") / F.lit(bucket_seconds * 1_000_000)) * F.lit(bucket_seconds)
    known = fixes.filter(F.col("vin").isNotNull()).withColumn("bucket", bucket)
    before = Window.partitionBy("vin", "bucket").orderBy(*_ORDER)
    segment = haversine_m(F.lag("lat").over(before), F.lag("lon").over(before), F.col("lat"), F.col("lon"))
    return known.withColumn("segment", segment).groupBy("vin", "bucket").agg(
        F.min(F.struct(*_ORDER)).alias("first"), F.max(F.struct(*_ORDER)).alias("last"),
        F.count(F.lit(1)).alias("fixes"), *(c.alias(n) for n, c in _lengths(F.col("segment")).items()))


def merge(summaries: DataFrame, *keys: str) -> DataFrame:
    """One summary per key from some that do not interleave."""
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("first"))
    between = haversine_m(before["lat"], before["lon"], F.col("first.lat"), F.col("first.lon"))
    own = _lengths(F.col("between"))
    return summaries.withColumn("between", between).groupBy(*keys).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("fixes").alias("fixes"),
        (F.sum("segments") + own["segments"]).alias("segments"),
        (F.sum("metres") + own["metres"]).cast("decimal(38,9)").alias("metres"),
        (F.sum("odd") + own["odd"]).alias("odd"), F.greatest(F.max("longest"), own["longest"]).alias("longest"))


def unknown_fixes(fixes: DataFrame) -> DataFrame:
    """Number of fixes of vehicles that are not known."""
    return fixes.filter(F.col("vin").isNull()).agg(F.count(F.lit(1)).alias("fixes"))


def distances(summaries: DataFrame, unknown: DataFrame) -> DataFrame:
    """Per vehicle: fixes, segments, total and longest segment in metres, from
    summaries by (vin, bucket) and counts of fixes without a vin."""
    daily = merge(summaries.withColumn("day", F.floor(F.col("bucket") / F.lit(_DAY_SECONDS))), "vin", "day")
    total = F.when(F.col("odd") > 0, lit_d(float("nan"))).otherwise(F.col("metres").cast("double"))
    known = merge(daily, "vin").select("vin", "fixes", "segments", total.alias("total_distance_m"), F.col("longest").alias("max_segment_m"))
    rest = unknown.agg(F.sum("fixes").alias("fixes")).filter("fixes > 0").select(
        F.lit(None).cast("string").alias("vin"), "fixes", F.lit(0).cast("long").alias("segments"),
        lit_d(0.0).alias("total_distance_m"), F.lit(None).cast("double").alias("max_segment_m"))
    return known.unionByName(rest)


def trip_distance(df: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Per vehicle: fixes, segments and metres between consecutive fixes."""
    fixes = fixes_of(df)
    return distances(summarise(fixes, bucket_seconds), unknown_fixes(fixes))


def interleaved(summaries: DataFrame) -> DataFrame:
    """(vin, bucket) of which some summaries overlap in time, so that they do
    not merge."""
    before = F.max("last").over(Window.partitionBy("vin", "bucket").orderBy("first", "last")
                                .rowsBetween(Window.unboundedPreceding, -1))
    return summaries.withColumn("_before", before).filter(F.col("_before") >= F.col("first")).select("vin", "bucket").distinct()


def extended(summaries: DataFrame, fixes: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Summaries that merge, from those of several batches: buckets whose
    summaries interleave (late rows) are summarised again from their fixes, all
    others stay as they are."""
    mixed = interleaved(summaries)
    bucket = F.floor(F.unix_micros("t") / F.lit(bucket_seconds * 1_000_000)) * F.lit(bucket_seconds)
    again = fixes.withColumn("bucket", bucket).join(mixed, ["vin", "bucket"], "left_semi").drop("bucket")
    return summaries.join(mixed, ["vin", "bucket"], "left_anti").unionByName(summarise(again, bucket_seconds))
