"""Answers about an archive from its files' statistics.

A date-partitioned parquet archive knows how many rows each day has without a
row being read: every file's footer holds its count. The scan takes the
aggregate over (``PushedAggregation`` in the plan), so the work grows with the
number of files, not of messages.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_V1 = "spark.sql.sources.useV1SourceList"
_PUSHDOWN = "spark.sql.parquet.aggregatePushdown"


@contextmanager
def _version_two(spark: SparkSession):
    """Parquet as the source that takes aggregates over, while a read is set up."""
    held = spark.conf.get(_V1)
    spark.conf.set(_V1, ",".join(s for s in held.split(",") if s != "parquet"))
    try:
        yield
    finally:
        spark.conf.set(_V1, held)


def archived_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows per day of a parquet archive partitioned by ``date``, newest first,
    counted from the footers. (Switches the session's aggregate push-down on;
    it concerns such scans only.)"""
    spark.conf.set(_PUSHDOWN, "true")
    schema = StructType([StructField("message_id", LongType()), StructField("date", StringType())])
    with _version_two(spark):
        days = spark.read.schema(schema).parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("total_records"))
    return days.orderBy(F.desc("date"))
