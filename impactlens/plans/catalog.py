"""Named queries: each reads the sf tables, runs one operator (or one
operator chain) and returns a DataFrame whose columns match the oracle
SQL of the same name in :mod:`impactlens.plans.oracle`.

Columns computed with transcendental functions (atan2, pow, sin/cos) are
rounded to 6 (3 for metres) because the JVM and C math libraries may differ
in the last bit; everything else is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from ..config import POLICY_FIRST_PARTITIONS, StorageConfig
from ..functions.sqlfuncs import register_table_function
from ..operators import detect as det
from ..operators.enrich import (
    LEAVES, PRESENCE, device_health, enrich, environment, gps_quality, heading, motion,
    with_leaves)
from ..operators.reconcile import (
    g_force_mismatches, g_force_reconciliation, magnetic_anomalies, speed_reconciliation)
from ..operators.report import crash_alerts, crash_reports, flatten
from ..operators.stats import (
    batch_summary, crash_events, crash_patterns, daily_counts, driving_stats, normal_events,
    preview, storage_stats, with_dates)
from ..operators.trips import trip_distance
from ..schema import CRASH_REPORT, TELEMETRY
from ..session import ensure_utc, light_checkpoints, scratch_path
from ..sources.compaction import compact_days, read_stream_archive, remove_superseded
from ..sources.filestats import archived_daily_counts
from ..sources.fixture import as_damaged_json, as_json, as_json_layouts, json_text, telemetry
from ..sources.ingest import parse_telemetry, prepare, quarantine_reason, with_event_time
from ..sources.messages import shares, stream_messages
from ..sources.outbox import published, write_outbox
from ..sources.sinks import (
    accident_alerts, archive_crash_reports, archive_telemetry, archive_with_fallback,
    publish_crash_reports, read_archive, report_archive_schema, stored_sample)
from ..streaming.baseline import start_running_anomalies
from ..streaming.jobs import (
    TRIGGER_INTERVAL, drain, judge, open_windows, quarantined, read_trips, read_window_parts, read_windowed_stats,
    start_crash_fanout, start_foreach_batch, start_report_outbox, start_trips, start_window_parts, start_windowed_stats, windowed_driving_stats)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


def good_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry that passed quarantine, with ``event_time``."""
    ensure_utc(spark)
    good, _ = prepare(telemetry(spark, sf_dir))
    return good


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


# --- B: enrichment -----------------------------------------------------------

@query("motion")
def q_motion(spark, sf_dir):
    return motion(good_rows(spark, sf_dir)).select(
        "message_id", "total_g_force", "lateral_g_force", "vertical_g_force", "gyro_magnitude",
        "rollover", "spinning", "pitching", "motion_type")


@query("heading")
def q_heading(spark, sf_dir):
    return heading(good_rows(spark, sf_dir)).select(
        "message_id", r6("heading"), r6("heading_computed"), "has_heading",
        "cardinal_direction", "mag_magnitude")


@query("gps_quality")
def q_gps_quality(spark, sf_dir):
    return gps_quality(good_rows(spark, sf_dir)).select(
        "message_id", "gps_speed_mph", "high_accuracy", "good_satellites", "gps_high_altitude",
        "gps_quality", "gps_reliable")


@query("environment")
def q_environment(spark, sf_dir):
    return environment(good_rows(spark, sf_dir)).select(
        "message_id", "weather_event", "high_altitude", r6("estimated_altitude_m"),
        "environmental_risk")


@query("device_health")
def q_device_health(spark, sf_dir):
    return device_health(good_rows(spark, sf_dir)).select(
        "message_id", "low_battery", "critical_battery", "weak_signal", "device_issues",
        "battery_percentage", "device_health_status", "signal_quality", "portrait", "landscape",
        "screen_active", "is_charging")


# --- C: detection, classification, scoring ---------------------------------

@query("crashes_message")
def q_crashes_message(spark, sf_dir):
    return det.detect(enrich(good_rows(spark, sf_dir)), "message").select(
        "message_id", "policy_id", "is_crash", "crash_type", "g_threshold")


@query("crashes_batch")
def q_crashes_batch(spark, sf_dir):
    return det.detect(enrich(good_rows(spark, sf_dir)), "batch").select(
        "message_id", "policy_id", "is_crash", "crash_type")


@query("risk_score")
def q_risk_score(spark, sf_dir):
    return det.risk_score(enrich(good_rows(spark, sf_dir))).select("message_id", "risk_score")


@query("risk_weight")
def q_risk_weight(spark, sf_dir):
    df = det.risk_weight(det.detect(enrich(good_rows(spark, sf_dir)), "batch"))
    return df.select("message_id", "crash_type", "risk_weight")


@query("risk_category")
def q_risk_category(spark, sf_dir):
    return det.risk_category(enrich(good_rows(spark, sf_dir))).select("message_id", "risk_category")


@query("severity")
def q_severity(spark, sf_dir):
    df = det.risk_weight(det.risk_score(enrich(good_rows(spark, sf_dir))))
    g = F.col("g_force")
    return df.select(
        "message_id",
        det.severity_level(g, g, F.col("risk_score")).alias("message_severity"),
        det.emergency(g, F.col("risk_score")).alias("message_emergency"),
        det.severity_level(g, F.col("total_g_force"), F.col("risk_weight")).alias("batch_severity"),
        det.emergency(g, F.col("risk_weight")).alias("batch_emergency"))


# --- A3: event time ------------------------------------------------------------

@query("event_time")
def q_event_time(spark, sf_dir):
    ensure_utc(spark)
    df = with_event_time(telemetry(spark, sf_dir))
    return df.select("message_id", "timestamp",
                     F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time_utc"),
                     F.col("event_time").isNotNull().alias("parsed"))


# --- C10-C12, C5: reports, alerts, triage -------------------------------------

def _analysed(spark, sf_dir, profile):
    return det.analyse(good_rows(spark, sf_dir), profile)


def _round_headings(df: DataFrame) -> DataFrame:
    cols = []
    for c in df.columns:
        if c.endswith("heading") or c.endswith("heading_degrees") or c == "estimated_altitude_m":
            cols.append(F.round(F.col(c), 6).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(cols)


def _flat_reports(spark, sf_dir, profile):
    reports, _ = crash_reports(_analysed(spark, sf_dir, profile), profile)
    flat = reports.drop("processed_timestamp")
    return _round_headings(flat.select(flatten(flat)))


@query("crash_reports_flat")
def q_crash_reports_flat(spark, sf_dir):
    return _flat_reports(spark, sf_dir, "message")


@query("crash_reports_batch_flat")
def q_crash_reports_batch_flat(spark, sf_dir):
    return _flat_reports(spark, sf_dir, "batch")


@query("crash_alerts")
def q_crash_alerts(spark, sf_dir):
    return _round_headings(crash_alerts(_analysed(spark, sf_dir, "message")))


@query("crash_triage")
def q_crash_triage(spark, sf_dir):
    df = det.triage_queue(det.detect(enrich(good_rows(spark, sf_dir)), "batch"))
    return df.select("message_id", "policy_id", "g_force", "speed_mph",
                     F.col("triage_type").alias("crash_type"), "severity_priority")


# --- D: SQL analysis, aggregations, previews --------------------------------

def _patterns(spark, sf_dir):
    return crash_patterns(spark, good_rows(spark, sf_dir))


@query("crash_patterns")
def q_crash_patterns(spark, sf_dir):
    return _round_headings(_patterns(spark, sf_dir))


@query("top_patterns")
def q_top_patterns(spark, sf_dir):
    return _round_headings(preview(_patterns(spark, sf_dir), "patterns"))


@query("patterns_compared")
def q_patterns_compared(spark, sf_dir):
    """G2/D1: one statement over the results of two threshold sets."""
    register_table_function(spark, good_rows(spark, sf_dir))
    return spark.sql("""
        SELECT coalesce(usual.message_id, strict.message_id) AS message_id, usual.crash_type AS usual_type,
               strict.crash_type AS strict_type
        FROM crashPatterns() AS usual
        FULL OUTER JOIN crashPatterns(gLimit => 2.5D, rolloverLimit => 4.0D, lateralLimit => 1.5D) AS strict
          ON usual.message_id = strict.message_id""")


@query("crash_events")
def q_crash_events(spark, sf_dir):
    df = crash_events(enrich(good_rows(spark, sf_dir)), "batch")
    return df.select("message_id", "policy_id", "total_g_force", det.crash_type("batch").alias("crash_type"))


@query("normal_events")
def q_normal_events(spark, sf_dir):
    df = normal_events(enrich(good_rows(spark, sf_dir)), "batch")
    return df.select("message_id", "policy_id", "total_g_force", "speed_mph")


@query("driving_stats")
def q_driving_stats(spark, sf_dir):
    df = driving_stats(enrich(good_rows(spark, sf_dir)))
    return df.select("policy_id", r6("avg_speed"), "max_g_force", "min_g_force",
                     r6("avg_risk_score"), "message_count")


@query("storage_stats")
def q_storage_stats(spark, sf_dir):
    return storage_stats(good_rows(spark, sf_dir)).select(
        "policy_id", "date", "record_count", r6("avg_speed"), "max_g_force", "min_g_force")


@query("top_storage")
def q_top_storage(spark, sf_dir):
    return preview(storage_stats(good_rows(spark, sf_dir)), "storage").select(
        "policy_id", "date", "record_count", r6("avg_speed"), "max_g_force", "min_g_force")


@query("daily_counts")
def q_daily_counts(spark, sf_dir):
    return daily_counts(good_rows(spark, sf_dir))


@query("recent_days")
def q_recent_days(spark, sf_dir):
    return preview(daily_counts(good_rows(spark, sf_dir)), "daily")


@query("batch_summary")
def q_batch_summary(spark, sf_dir):
    ensure_utc(spark)
    df = with_event_time(telemetry(spark, sf_dir))
    tagged = det.detect(enrich(df.withColumn("reason", quarantine_reason(df))), "message")
    return batch_summary(tagged)


@query("quarantine")
def q_quarantine(spark, sf_dir):
    """Every reason in one pass: the ingest reason, else why a crash's report
    cannot be built."""
    ensure_utc(spark)
    return quarantined(with_event_time(telemetry(spark, sf_dir))).select("message_id", "reason")


@query("accident_alerts")
def q_accident_alerts(spark, sf_dir):
    return accident_alerts(good_rows(spark, sf_dir))


@query("driving_stats_30s")
def q_driving_stats_30s(spark, sf_dir):
    df = windowed_driving_stats(enrich(good_rows(spark, sf_dir)), watermark=None)
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     "policy_id", r6("avg_speed"), "max_g_force", "min_g_force",
                     r6("avg_risk_score"), "message_count")


# --- E: reconciliation -------------------------------------------------------

@query("g_force_reconciliation")
def q_g_force_reconciliation(spark, sf_dir):
    df = g_force_reconciliation(motion(good_rows(spark, sf_dir)))
    return df.select("policy_id", "messages", "mismatches", r6("mismatch_rate"), r6("avg_abs_diff"))


@query("g_force_mismatches")
def q_g_force_mismatches(spark, sf_dir):
    return g_force_mismatches(motion(good_rows(spark, sf_dir))).select(
        "message_id", "policy_id", "vin", "g_force", r6("total_g_force"), r6("abs_diff"))


@query("speed_reconciliation")
def q_speed_reconciliation(spark, sf_dir):
    df = speed_reconciliation(gps_quality(good_rows(spark, sf_dir)))
    return df.select("policy_id", "fixes", "mismatches", r6("avg_abs_diff_mph"),
                     r6("max_abs_diff_mph"))


def _trip_view(df):
    return df.select("vin", "fixes", "segments", F.round("total_distance_m", 3).alias("total_distance_m"),
                     F.round("max_segment_m", 3).alias("max_segment_m"))


@query("trip_distance")
def q_trip_distance(spark, sf_dir):
    return _trip_view(trip_distance(good_rows(spark, sf_dir)))


@query("magnetic_anomalies")
def q_magnetic_anomalies(spark, sf_dir):
    df = magnetic_anomalies(heading(good_rows(spark, sf_dir)))
    return df.select("message_id", "vin", r6("mag_magnitude"), r6("baseline_magnitude"),
                     r6("deviation"))


# --- A1/A2/A4: JSON ingest ---------------------------------------------------

def _leaf_view(df: DataFrame, *extra: str) -> DataFrame:
    return with_leaves(df).select(
        "message_id", "policy_id", "vin", "timestamp", "speed_mph", "current_street", "g_force",
        *LEAVES.keys(), *PRESENCE.keys(), "reason", *extra)


def _ingest(spark, sf_dir, layout):
    ensure_utc(spark)
    parsed = with_event_time(parse_telemetry(as_json(telemetry(spark, sf_dir), layout)))
    return _leaf_view(parsed.withColumn("reason", quarantine_reason(parsed)))


@query("json_ingest")
def q_json_ingest(spark, sf_dir):
    return _ingest(spark, sf_dir, "code")


@query("json_layouts")
def q_json_layouts(spark, sf_dir):
    """Every message in all three layouts (one pass over the table, one
    parser for all layouts)."""
    ensure_utc(spark)
    texts = as_json_layouts(telemetry(spark, sf_dir))
    parsed = with_event_time(parse_telemetry(texts, carry=("layout",)))
    return _leaf_view(parsed.withColumn("reason", quarantine_reason(parsed)), "layout")


@query("json_damaged")
def q_json_damaged(spark, sf_dir):
    """Messages as faulty devices send them: what is read, and every reason."""
    ensure_utc(spark)
    parsed = parse_telemetry(as_damaged_json(telemetry(spark, sf_dir)))
    return with_leaves(judge(parsed)).select(
        "message_id", "policy_id", "vin", "g_force", "screen_on", "has_magnetometer", "has_device", "reason")


# --- A5-A8: sinks, read back -------------------------------------------------

def _archived(spark, sf_dir, name, parts=("year", "month", "date"), **options):
    """Writes and reads back one archive."""
    path = scratch_path(spark, f"archive-{name}")
    archive_telemetry(good_rows(spark, sf_dir), StorageConfig(path=path, partition_cols=parts, **options))
    return read_archive(spark, path, parts if options.get("partitioning_enabled", True) else (),
                        options.get("fmt", "parquet"))


@query("archive_roundtrip")
def q_archive_roundtrip(spark, sf_dir):
    return stored_sample(_archived(spark, sf_dir, "parquet"))


@query("archive_daily_counts")
def q_archive_daily_counts(spark, sf_dir):
    """D5 of an archive from its files' footers."""
    path = scratch_path(spark, "archive-daily")
    archive_telemetry(good_rows(spark, sf_dir), StorageConfig(path=path, partition_cols=("date",)))
    return archived_daily_counts(spark, path)


@query("archive_policy_first")
def q_archive_policy_first(spark, sf_dir):
    return stored_sample(_archived(spark, sf_dir, "policy", POLICY_FIRST_PARTITIONS))


@query("archive_unpartitioned")
def q_archive_unpartitioned(spark, sf_dir):
    return stored_sample(_archived(spark, sf_dir, "flat", partitioning_enabled=False))


@query("archive_json")
def q_archive_json(spark, sf_dir):
    return stored_sample(_archived(spark, sf_dir, "json", fmt="json", compression="gzip"))


@query("archive_csv")
def q_archive_csv(spark, sf_dir):
    """CSV holds no structs: columns are flat, values text."""
    path = scratch_path(spark, "archive-csv")
    archive_telemetry(good_rows(spark, sf_dir), StorageConfig(path=path, fmt="csv", compression="gzip",
                                                              partitioning_enabled=False))
    df = spark.read.option("header", "true").csv(path)
    return df.select(F.col("message_id").cast("long").alias("message_id"), "policy_id", "vin",
                     F.col("g_force").cast("double").alias("g_force"),
                     F.col("sensors_gps_lat").cast("double").alias("latitude"), "date", "hour")


@query("archive_fallback")
def q_archive_fallback(spark, sf_dir):
    """The archive's folder exists already and must not: the write fails."""
    base = scratch_path(spark, "fallback")
    good = good_rows(spark, sf_dir)
    good.limit(1).write.parquet(base)
    written = archive_with_fallback(good, StorageConfig(path=base, mode="error"), batch_id=0)
    if not written.fallback:
        raise RuntimeError("the primary write should have failed")
    schema = StructType(TELEMETRY.fields + [StructField("event_time", TimestampType()),
                                            StructField("write_timestamp", TimestampType())])
    return stored_sample(with_dates(spark.read.schema(schema).json(written.path)))


@query("reports_roundtrip")
def q_reports_roundtrip(spark, sf_dir):
    reports, _ = crash_reports(_analysed(spark, sf_dir, "message"), "message")
    target = archive_crash_reports(reports, scratch_path(spark, "reports"))
    back = read_archive(spark, target, ("severity_level", "report_date"), schema=report_archive_schema())
    back = back.drop("processed_timestamp")
    return _round_headings(back.select(flatten(back)))


@query("reports_json_flat")
def q_reports_json_flat(spark, sf_dir):
    """Reports as compressed JSON without partitions."""
    reports, _ = crash_reports(_analysed(spark, sf_dir, "message"), "message")
    target = archive_crash_reports(reports, scratch_path(spark, "reports-json"), fmt="json",
                                   compression="gzip", partitioning_enabled=False)
    back = read_archive(spark, target, (), "json", report_archive_schema()).drop("processed_timestamp")
    return _round_headings(back.select(flatten(back)))


@query("published_null_fields")
def q_published_null_fields(spark, sf_dir):
    """Documents as text: null fields are there."""
    reports, _ = crash_reports(_analysed(spark, sf_dir, "message"), "message")
    docs = publish_crash_reports(reports).withColumn("k", F.json_object_keys("value"))
    return docs.select(F.get_json_object("value", "$.report_id").alias("report_id"),
                       F.size("k").cast("long").alias("fields"),
                       F.contains("value", F.lit('"accuracy_meters":null')).alias("null_accuracy"))


@query("published_reports")
def q_published_reports(spark, sf_dir):
    reports, _ = crash_reports(_analysed(spark, sf_dir, "message"), "message")
    path = scratch_path(spark, "published")
    publish_crash_reports(reports).write.text(path)
    back = spark.read.schema(CRASH_REPORT).json(path).drop("processed_timestamp")
    return _round_headings(back.select(flatten(back)))


# --- F: streaming --------------------------------------------------------------

def _landing(spark, sf_dir) -> str:
    """Messages as JSON lines in a landing folder (the stream's source)."""
    ensure_utc(spark)
    path = scratch_path(spark, "landing")
    as_json(telemetry(spark, sf_dir)).write.text(path)
    return path


def _fanout(spark, sf_dir, **options):
    src = _landing(spark, sf_dir)
    handles = start_crash_fanout(spark, src, scratch_path(spark, "stream-out"),
                                 scratch_path(spark, "stream-ckpt"), available_now=True, **options)
    handles.await_all()
    return handles


def _stream_reports(spark, handles):
    back = spark.read.parquet(handles.reports).drop("batch_id")
    return _round_headings(back.select(flatten(back)))


@query("stream_equals_batch")
def q_stream_equals_batch(spark, sf_dir):
    return _stream_reports(spark, _fanout(spark, sf_dir))


@query("stream_archive")
def q_stream_archive(spark, sf_dir):
    handles = _fanout(spark, sf_dir)
    return stored_sample(read_archive(spark, handles.telemetry, ("batch_id", "date")))


@query("stream_compaction")
def q_stream_compaction(spark, sf_dir):
    """F3/A5: the archive of a stream is compacted twice, with batches (and
    late rows for days that are over) in between and after."""
    ensure_utc(spark)
    src, out, ckpt = (scratch_path(spark, n) for n in ("compact-in", "compact-out", "compact-ckpt"))
    rows = telemetry(spark, sf_dir)
    for part in range(3):
        as_json(rows.filter(F.col("message_id") % 3 == part)).write.mode("append").text(src)
        handles = start_crash_fanout(spark, src, out, ckpt, available_now=True)
        handles.await_all()
        if part < 2:
            compact_days(spark, handles.telemetry, ("2024-01-11", "2024-01-21")[part])
    remove_superseded(spark, handles.telemetry)
    return stored_sample(read_stream_archive(spark, handles.telemetry))


@query("stream_quarantine")
def q_stream_quarantine(spark, sf_dir):
    return spark.read.parquet(_fanout(spark, sf_dir).quarantine).select("message_id", "reason")


@query("stream_bounded_batches")
def q_stream_bounded_batches(spark, sf_dir):
    """F2: a file per micro-batch gives the same reports."""
    return _stream_reports(spark, _fanout(spark, sf_dir, max_files_per_trigger=1))


#: Messages of one file of an ordered landing folder, about, at most: what one
#: task sorts and holds does not grow with the table.
MESSAGES_PER_FILE = 100_000


def _ordered_landing(spark, sf_dir, parts: int = 1, by: str = "message_id") -> str:
    """A landing folder whose files, in order of their names, hold the messages
    in order: ``parts`` files, or more where these would hold too many messages."""
    ensure_utc(spark)
    path = scratch_path(spark, "landing")
    rows = telemetry(spark, sf_dir)
    parts = max(parts, -(-rows.count() // MESSAGES_PER_FILE))
    keyed = with_event_time(rows).select(F.col(by).alias("_by"), "message_id", json_text(rows).alias("value"))
    dealt = keyed.repartitionByRange(parts, "_by", "message_id") if parts > 1 else keyed.coalesce(1)
    dealt.sortWithinPartitions("_by", "message_id").select("value").write.text(path)
    return path


#: Streams side by side that share a landing folder, at most, and micro-batches
#: of a share, at least.
ADMISSION_STREAMS, ADMISSION_BATCHES = 4, 4


@query("stream_admission")
def q_stream_admission(spark, sf_dir):
    """F2: a hundred messages a micro-batch from large files, by running
    triggers; streams side by side, each of a share of the folder, are stopped
    once and started again."""
    src = _ordered_landing(spark, sf_dir)
    out, ckpt = scratch_path(spark, "admission-out"), scratch_path(spark, "admission-ckpt")
    parts = shares(spark, src, ADMISSION_STREAMS, ADMISSION_BATCHES)
    done = [0] * len(parts)

    def start(k, share):
        def keep(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={share.first + batch_id}")
            done[k] += 1

        parsed = parse_telemetry(stream_messages(spark, src, f"{ckpt}/{k}/admissions", share=share), fields=("message_id",))
        return (parsed.select("message_id").writeStream.foreachBatch(keep)
                .option("checkpointLocation", f"{ckpt}/{k}").trigger(processingTime="0 seconds").start())

    with light_checkpoints(spark, ckpt):
        first = [start(k, share) for k, share in enumerate(parts)]
        try:
            for k, share in enumerate(parts):
                while done[k] < min(2, share.batches) and first[k].isActive:
                    first[k].awaitTermination(0.1)
        finally:
            for running in first:
                running.stop()
        drain(*(start(k, share) for k, share in enumerate(parts)))
    rows = spark.read.schema("message_id long, batch_id long").parquet(out)
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct("message_id").alias("distinct_messages"),
        F.min("message_id").alias("first_id"), F.max("message_id").alias("last_id"))


@query("stream_trigger")
def q_stream_trigger(spark, sf_dir):
    """the fan-out runs every two seconds while messages land in two
    parts, and is stopped when all have been processed."""
    ensure_utc(spark)
    src, out, ckpt = (scratch_path(spark, n) for n in ("trigger-in", "trigger-out", "trigger-ckpt"))
    rows, handles = telemetry(spark, sf_dir), None
    for part in (0, 1):
        as_json(rows.filter(F.col("message_id") % 2 == part)).write.mode("append").text(src)
        if handles is None:
            handles = start_crash_fanout(spark, src, out, ckpt, interval=TRIGGER_INTERVAL)
    handles.drain()
    return _stream_reports(spark, handles)


@query("stream_restart")
def q_stream_restart(spark, sf_dir):
    """the job stops, more messages land, it goes on where it was."""
    ensure_utc(spark)
    src, out, ckpt = (scratch_path(spark, n) for n in ("restart-in", "restart-out", "restart-ckpt"))
    texts = telemetry(spark, sf_dir)
    for part in (0, 1):
        half = texts.filter(F.col("message_id") % 2 == part)
        as_json(half).write.mode("append").text(src)
        handles = start_crash_fanout(spark, src, out, ckpt, available_now=True)
        handles.await_all()
    return _stream_reports(spark, handles)


@query("stream_metrics")
def q_stream_metrics(spark, sf_dir):
    """counts of every micro-batch while the stream ran."""
    rows = _fanout(spark, sf_dir, max_files_per_trigger=1).batch_counts()
    return rows.agg(F.sum("messages").alias("messages"), F.sum("crashes").alias("crashes"))


@query("stream_window_stats")
def q_stream_window_stats(spark, sf_dir):
    """F4 on a stream: 30 s windows, every window in its last state."""
    src = _landing(spark, sf_dir)
    out, ckpt = scratch_path(spark, "window-out"), scratch_path(spark, "window-ckpt")
    start_windowed_stats(spark, src, out, ckpt, available_now=True).awaitTermination()
    df = read_windowed_stats(spark, out)
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     "policy_id", r6("avg_speed"), "max_g_force", "min_g_force",
                     r6("avg_risk_score"), "message_count")


@query("stream_late_windows")
def q_stream_late_windows(spark, sf_dir):
    """F4 with late rows: messages are dealt over files regardless of their
    time and a micro-batch takes one file, so most windows get rows far behind
    the latest event time."""
    ensure_utc(spark)
    src, out, ckpt = (scratch_path(spark, n) for n in ("late-in", "late-out", "late-ckpt"))
    rows = telemetry(spark, sf_dir)
    as_json(rows.repartition(8, F.xxhash64("message_id"))).write.text(src)
    start_window_parts(spark, src, out, ckpt, available_now=True, max_files_per_trigger=1).awaitTermination()
    df = read_window_parts(spark, out)
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     "policy_id", r6("avg_speed"), "max_g_force", "min_g_force",
                     r6("avg_risk_score"), "message_count")


@query("stream_trips")
def q_stream_trips(spark, sf_dir):
    """E3 on a stream: each batch extends the stored summaries; messages come
    in disorder, so many buckets get rows of several batches."""
    ensure_utc(spark)
    src, out, ckpt = (scratch_path(spark, n) for n in ("trips-in", "trips-out", "trips-ckpt"))
    rows = telemetry(spark, sf_dir)
    as_json(rows.repartition(4, F.xxhash64("message_id"))).write.text(src)
    start_trips(spark, src, out, ckpt, available_now=True, max_files_per_trigger=1).awaitTermination()
    return _trip_view(read_trips(spark, out))


@query("stream_magnetic_running")
def q_stream_magnetic_running(spark, sf_dir):
    """E4 with keyed state: messages land in order of event time and come in
    three micro-batches; each is compared with those of its vehicle before it."""
    src = _ordered_landing(spark, sf_dir, 4, "event_time")
    out, ckpt = scratch_path(spark, "running-out"), scratch_path(spark, "running-ckpt")
    third = -(-spark.read.text(src).count() // 3)
    drain(start_running_anomalies(spark, src, out, ckpt, interval="0 seconds", max_messages_per_trigger=third))
    back = spark.read.parquet(out)
    return back.select("message_id", "vin", r6("mag_magnitude"), r6("baseline_magnitude"), r6("deviation"))


@query("stream_outbox")
def q_stream_outbox(spark, sf_dir):
    """A8/F5: reports published exactly once although a batch fails half-way
    (a document after some written ones cannot be made) and is run again."""
    ensure_utc(spark)
    src, out, ckpt = (scratch_path(spark, n) for n in ("outbox-in", "outbox-out", "outbox-ckpt"))
    rows = telemetry(spark, sf_dir)
    for part in (0, 1):
        as_json(rows.filter(F.col("message_id") % 2 == part)).write.mode("append").text(src)
        if part:
            good, _ = prepare(parse_telemetry(spark.readStream.schema("value string").text(src)))
            reports, _ = crash_reports(det.analyse(good, "message"), "message")
            broken = F.when(F.xxhash64("value") % 50 == 0, F.raise_error(F.lit("lost connection"))).otherwise(F.col("value"))
            failing = publish_crash_reports(reports).select(broken.alias("value"))
            try:
                write_outbox(failing, out, ckpt, {"availableNow": True}).awaitTermination()
            except StreamingQueryException:
                pass  # the batch is logged and not committed: the next start runs it again
        start_report_outbox(spark, src, out, ckpt, available_now=True).awaitTermination()
    docs = published(spark, out).select(F.from_json("value", CRASH_REPORT).alias("r")).select("r.*").drop("processed_timestamp")
    return _round_headings(docs.select(flatten(docs)))


@query("stream_open_windows")
def q_stream_open_windows(spark, sf_dir):
    """the windows in the state after each of three micro-batches of
    messages in order of event time, from the checkpoint."""
    src = _ordered_landing(spark, sf_dir, 4, "event_time")
    ckpt = scratch_path(spark, "open-ckpt")
    third = -(-spark.read.text(src).count() // 3)
    drain(start_windowed_stats(spark, src, scratch_path(spark, "open-out"), ckpt, interval="0 seconds",
                               max_messages_per_trigger=third))
    after = [open_windows(spark, ckpt, n).select(F.lit(n).cast("long").alias("batch_id"), "window_start", "policy_id") for n in range(3)]
    return after[0].unionByName(after[1]).unionByName(after[2]).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("foreach_batch_reports")
def q_foreach_batch_reports(spark, sf_dir):
    """G3/F3 for external targets: each micro-batch is persisted, its crash
    reports are written by a handler keyed by batch id (idempotent on
    replay), and the batch is released."""
    src = _landing(spark, sf_dir)
    out, ckpt = scratch_path(spark, "fb-out"), scratch_path(spark, "fb-ckpt")

    def handler(reports, alerts, batch_id):
        (reports.drop("processed_timestamp").write.mode("overwrite")
         .parquet(f"{out}/batch_id={batch_id}"))

    start_foreach_batch(spark, src, handler, ckpt, available_now=True).awaitTermination()
    back = spark.read.parquet(out).drop("batch_id")
    return _round_headings(back.select(flatten(back)))
