"""Archives and outbound feeds.

* :func:`archive_telemetry` - all telemetry, partitioned files (parquet by
  default; json, csv, or any Spark data source name such as ``delta``).
* :func:`archive_with_fallback` - the same, falling back to unpartitioned
  JSON under ``<path>/fallback/<batch id>`` when the primary write fails.
* :func:`archive_crash_reports` - reports partitioned by severity and date.
* :func:`publish_crash_reports` - one JSON document per crash (``value``).
* :func:`accident_alerts` - concise alert rows for a downstream table.

Writes go through ``REBALANCE`` on the partition columns (with the policy
first, on the policy: :func:`_together`): adaptive
execution sizes the output tasks from the real data, splitting a partition
value that holds a large share of the rows (one chatty policy, or the one
``CRITICAL`` severity value) instead of sending it through a single task,
and merging small ones so each directory gets few, large files. With the
policy first a task's time goes with its folders, not its bytes, and a policy
is with one task anyway: small tasks are not merged there.
"""

from __future__ import annotations

import logging
from contextlib import contextmanager
from typing import NamedTuple

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..config import REPORT_PARTITIONS, StorageConfig
from ..functions.columns import gt, parse_event_time
from ..operators.report import flatten
from ..operators.stats import with_dates
from ..schema import CRASH_REPORT, TELEMETRY

log = logging.getLogger(__name__)

_MODES = {"append": "append", "overwrite": "overwrite", "ignore": "ignore",
          "error": "error", "errorifexists": "error"}


def save_mode(name: str) -> str:
    try:
        return _MODES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown save mode {name!r}") from None


def telemetry_for_archive(df: DataFrame) -> DataFrame:
    """Adds date/hour/year/month (UTC, from event time) and processed time."""
    return with_dates(df).withColumn("processed_timestamp", F.current_timestamp())


_CALENDAR = ("year", "month", "date", "hour")


def _together(partition_cols) -> list[str]:
    """Columns whose equal rows one task writes: those that lead the calendar
    ones, so that all days of a policy are made, and moved into the archive as
    one folder, by one task; all columns where a calendar one leads."""
    cols = list(partition_cols)
    first = next((i for i, c in enumerate(cols) if c in _CALENDAR), 0)
    return cols[:first] or cols


@contextmanager
def _unmerged(spark, wanted: bool):
    """Adaptive execution merges no small tasks meanwhile."""
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    held = spark.conf.get(merging)
    if wanted:
        spark.conf.set(merging, "false")
    try:
        yield
    finally:
        if wanted:
            spark.conf.set(merging, held)


def _write(df: DataFrame, path: str, fmt: str, partition_cols, compression: str | None,
           mode: str, max_records_per_file: int | None = None) -> None:
    fmt = (fmt or "parquet").lower()
    if fmt == "csv":
        df = df.select(flatten(df))  # CSV cannot hold structs
    together = _together(partition_cols)
    if partition_cols:
        df = df.hint("rebalance", *together)
    writer = df.write.mode(save_mode(mode))
    if compression and fmt in ("parquet", "json", "csv", "orc"):
        writer = writer.option("compression", compression)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", str(max_records_per_file))
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if fmt not in ("parquet", "json", "csv", "orc", "delta", "text"):
        fmt = "parquet"  # unknown names fall back to parquet
    with _unmerged(df.sparkSession, len(together) < len(partition_cols)):
        writer.format(fmt).save(path)


def archive_telemetry(df: DataFrame, cfg: StorageConfig) -> str | None:
    """Writes telemetry (with partition columns) and returns the path, or
    ``None`` when storage is disabled."""
    if not cfg.enabled:
        return None
    out = telemetry_for_archive(df)
    parts = list(cfg.partition_cols) if cfg.partitioning_enabled else []
    _write(out, cfg.path, cfg.fmt, parts, cfg.compression, cfg.mode, cfg.max_records_per_file)
    return cfg.path


class Archived(NamedTuple):
    """Where a batch went, and why not to the archive if it did not."""

    path: str | None
    fallback: bool = False
    cause: str | None = None


def _is_data_error(error: Exception) -> bool:
    """Whether the frame's own rows made a write fail (SQL states of data
    exceptions, raised errors and user code): no other target would mend it."""
    cause = error.java_exception if isinstance(error, Py4JJavaError) else getattr(error, "_origin", None)
    while cause is not None:
        try:
            state = cause.getSqlState()
        except Py4JError:  # an exception that has none
            state = None
        if state and state[:2] in ("22", "38", "39", "P0"):
            return True
        cause = cause.getCause()
    return False


def archive_with_fallback(df: DataFrame, cfg: StorageConfig, batch_id: str | int) -> Archived:
    """Primary archive; if that write fails, unpartitioned JSON keyed by
    ``batch_id`` (a re-run of the same batch overwrites its own fallback, never
    duplicates; :func:`restore_fallback` takes it into the archive). Faults of
    the frame itself (a wrong column, an unknown save mode, a row that cannot
    be computed) are raised, as no write would mend them."""
    telemetry_for_archive(df).schema  # analyses the frame
    save_mode(cfg.mode)
    try:
        return Archived(archive_telemetry(df, cfg))
    except (Py4JJavaError, PySparkException) as e:
        if _is_data_error(e):
            raise
        path = f"{cfg.path.rstrip('/')}/fallback/{batch_id}"
        log.warning("archive of batch %s failed, writing %s: %s", batch_id, path, e)
        df.withColumn("write_timestamp", F.current_timestamp()).write.mode("overwrite").json(path)
        return Archived(path, True, str(e))


def restore_fallback(spark, cfg: StorageConfig, batch_id: str | int) -> str | None:
    """Takes the fallback of a batch into the archive and removes it; ``None``
    if there is none. The rows are written beside the archive first, complete,
    then their files are moved in one by one, so a restore that was interrupted
    goes on where it was when it is run again, and no row is there twice."""
    root = cfg.path.rstrip("/")
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    held, stage = path_of(f"{root}/fallback/{batch_id}"), path_of(f"{root}/_restore-{batch_id}")
    fs = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done, whole = path_of(stage, "_done"), path_of(stage, "_SUCCESS")
    if fs.exists(done):  # only its last step was missing
        fs.delete(stage, True)
    if not fs.exists(held):
        return None
    if not fs.exists(whole):
        schema = StructType([*TELEMETRY.fields, StructField("event_time", TimestampType())])
        parts = list(cfg.partition_cols) if cfg.partitioning_enabled else []
        _write(telemetry_for_archive(spark.read.schema(schema).json(held.toString())), stage.toString(), cfg.fmt, parts,
               cfg.compression, "overwrite", cfg.max_records_per_file)
    files, staged = [], fs.resolvePath(stage).toString()
    found = fs.listFiles(stage, True)
    while found.hasNext():
        files.append(found.next().getPath())
    for file in files:
        if file.getName().startswith("part-"):
            target = path_of(f"{root}/{file.toString()[len(staged) + 1:]}")
            fs.mkdirs(target.getParent())
            fs.rename(file, target)
    fs.rename(held, done)
    fs.delete(stage, True)
    return cfg.path


def archive_crash_reports(reports: DataFrame, path: str, fmt: str = "parquet", mode: str = "append",
                          compression: str | None = "snappy", partitioning_enabled: bool = True,
                          enabled: bool = True) -> str | None:
    """Reports under ``<path>/crash-reports`` partitioned by severity and
    UTC report date (taken from the crash's event time); ``None`` when
    storage is disabled."""
    if not enabled:
        return None
    t = parse_event_time(F.col("crash_timestamp"))
    out = reports.withColumns({"report_date": F.date_format(t, "yyyy-MM-dd"),
                               "report_hour": F.date_format(t, "HH")})
    fmt = fmt.lower() if fmt and fmt.lower() in ("parquet", "json") else "parquet"
    if fmt == "json" and compression == "snappy":
        compression = "gzip"  # a snappy text stream needs native libraries to read
    target = f"{path.rstrip('/')}/crash-reports"
    _write(out, target, fmt, list(REPORT_PARTITIONS) if partitioning_enabled else [], compression, mode)
    return target


def publish_crash_reports(reports: DataFrame) -> DataFrame:
    """One JSON document per report in a ``value`` column (for a text,
    file or message-broker sink). Null fields are written as null."""
    cols = [c for c in (f.name for f in CRASH_REPORT.fields) if c in reports.columns]
    return reports.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def accident_alerts(df: DataFrame, threshold_g: float = 4.0) -> DataFrame:
    """Concise potential-accident rows: sudden deceleration above the
    threshold (the reported g stands in for deceleration g)."""
    return df.filter(gt(F.col("g_force"), threshold_g)).select(
        "message_id", "policy_id", "vin",
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time_utc"),
        "g_force", "speed_mph",
        F.col("sensors.gps.lat").alias("latitude"), F.col("sensors.gps.lon").alias("longitude"),
        "current_street",
        F.lit("potential_accident").alias("alert_type"),
    )


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").parquet(path)


def telemetry_archive_schema() -> StructType:
    """Columns of :func:`archive_telemetry`'s files and folders."""
    dates = [StructField(c, StringType()) for c in ("date", "hour", "year", "month")]
    return StructType([*TELEMETRY.fields, StructField("event_time", TimestampType()), *dates,
                       StructField("processed_timestamp", TimestampType())])


def report_archive_schema() -> StructType:
    """Columns of :func:`archive_crash_reports`'s files and folders."""
    return StructType([*CRASH_REPORT.fields, StructField("message_id", LongType()),
                       StructField("report_date", StringType()), StructField("report_hour", StringType())])


def read_archive(spark, path: str, partition_cols=(), fmt: str = "parquet",
                 schema: StructType | None = None) -> DataFrame:
    """Reads an archive back, partition values as the strings they were
    written as (``month=01`` stays ``"01"``). The schema is known (telemetry
    by default), so nothing is inferred."""
    fields = (schema or telemetry_archive_schema()).fields
    fields = [f for f in fields if f.name not in partition_cols]
    fields += [StructField(c, StringType(), True) for c in partition_cols]
    rows = spark.read.format(fmt).schema(StructType(fields)).load(path)
    many = len(_together(partition_cols)) < len(partition_cols)
    return rows.coalesce(_read_tasks(spark, path)) if many else rows


#: Files and bytes that one task reads of an archive of many small files, at
#: most: Spark counts 4 MB for opening a file and so gives a task few of them.
FILES_PER_TASK, BYTES_PER_TASK = 256, 16 << 20


def _read_tasks(spark, path: str) -> int:
    """Tasks that read an archive, at most."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at)
    return max(1, -(-held.getFileCount() // FILES_PER_TASK), -(-held.getLength() // BYTES_PER_TASK))


def stored_sample(df: DataFrame) -> DataFrame:
    """The column sample shown for a written telemetry batch."""
    return df.select(
        "message_id", "policy_id", "vin", "current_street", "g_force", "speed_mph",
        F.col("sensors.gps.lat").alias("latitude"), F.col("sensors.gps.lon").alias("longitude"),
        F.col("sensors.gps.accuracy").alias("accuracy"),
        F.col("sensors.gyroscope.x").alias("pitch"), F.col("sensors.gyroscope.y").alias("roll"),
        F.col("sensors.gyroscope.z").alias("yaw"),
        F.col("sensors.device.battery_level").alias("battery_level"),
        "year", "month", "date", "hour")
