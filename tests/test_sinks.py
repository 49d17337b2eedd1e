"""Archives, fallback, report partitions, published JSON and alerts."""

import glob
import os

import pytest
from helpers import analysed, frame, message
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from impactlens.config import POLICY_FIRST_PARTITIONS, StorageConfig
from impactlens.operators.report import crash_reports
from impactlens.schema import CRASH_REPORT, TELEMETRY
from impactlens.sources import sinks
from impactlens.sources.ingest import parse_telemetry, prepare
from impactlens.sources.sinks import (accident_alerts, append_alerts, archive_crash_reports,
                                      archive_telemetry, archive_with_fallback,
                                      publish_crash_reports, read_archive, restore_fallback, save_mode)


def _good(spark, docs):
    return prepare(parse_telemetry(frame(spark, docs)))[0]


def test_default_layout_keeps_string_partitions(spark, tmp_path):
    good = _good(spark, [message(1), message(2, policy_id=None)])
    path = str(tmp_path / "t")
    assert archive_telemetry(good, StorageConfig(path=path, mode="APPEND", partition_cols=POLICY_FIRST_PARTITIONS)) == path
    assert os.path.isdir(f"{path}/policy_id=TEST-POLICY/year=2024/month=07/date=2024-07-24")
    back = read_archive(spark, path, ("policy_id", "year", "month", "date"))
    rows = {r["message_id"]: r for r in back.collect()}
    assert rows[1]["month"] == "07" and rows[1]["hour"] == "10"
    assert rows[2]["policy_id"] is None
    assert "processed_timestamp" in back.columns


def test_one_task_makes_all_folders_of_a_policy(spark, tmp_path):
    days = [message(10 * p + d, policy_id=f"P{p}", timestamp=f"2024-07-{d:02d}T10:00:00Z") for p in range(6) for d in range(1, 10)]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    held = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        path = archive_telemetry(_good(spark, days), StorageConfig(path=str(tmp_path / "t"), partition_cols=POLICY_FIRST_PARTITIONS))
    finally:
        spark.conf.set(coalesce, held)
    for p in range(6):
        files = glob.glob(f"{path}/policy_id=P{p}/year=2024/month=07/date=*/part-*.parquet")
        assert len(files) == 9 and len({os.path.basename(f).split("-")[1] for f in files}) == 1


def test_small_files_of_policies_are_shared_out(spark, tmp_path, monkeypatch):
    """However few bytes: several tasks make the folders, and a task reads many
    of their files, but no more than it may."""
    days = [message(10 * p + d, policy_id=f"P{p}", timestamp=f"2024-07-{d:02d}T10:00:00Z") for p in range(6) for d in range(1, 10)]
    merging = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    path = archive_telemetry(_good(spark, days), StorageConfig(path=str(tmp_path / "t"), partition_cols=POLICY_FIRST_PARTITIONS))
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == merging == "true"
    files = glob.glob(f"{path}/policy_id=*/year=2024/month=07/date=*/part-*.parquet")
    assert len(files) == 54 and len({os.path.basename(f).split("-")[1] for f in files}) > 1
    back = read_archive(spark, path, POLICY_FIRST_PARTITIONS)
    assert back.rdd.getNumPartitions() == 1
    monkeypatch.setattr(sinks, "FILES_PER_TASK", 20)
    assert read_archive(spark, path, POLICY_FIRST_PARTITIONS).rdd.getNumPartitions() == 3
    monkeypatch.setattr(sinks, "BYTES_PER_TASK", 1)
    most = read_archive(spark, path, POLICY_FIRST_PARTITIONS)
    assert most.rdd.getNumPartitions() > 3
    for rows in (back, most):
        assert sorted(r.message_id for r in rows.collect()) == [10 * p + d for p in range(6) for d in range(1, 10)]


def test_formats(spark, tmp_path):
    good = _good(spark, [message(1)])
    csv = str(tmp_path / "csv")
    archive_telemetry(good, StorageConfig(path=csv, fmt="csv", partitioning_enabled=False))
    header = spark.read.option("header", "true").csv(csv)
    assert "sensors_accelerometer_x" in header.columns
    other = str(tmp_path / "other")
    archive_telemetry(good, StorageConfig(path=other, fmt="something-else",
                                          partitioning_enabled=False))
    assert spark.read.parquet(other).count() == 1
    assert archive_telemetry(good, StorageConfig(path=str(tmp_path / "off"), enabled=False)) is None
    assert save_mode("Append") == "append" and save_mode("ErrorIfExists") == "error"


def test_fallback(spark, tmp_path, caplog):
    good = _good(spark, [message(1), message(2)])
    base = str(tmp_path / "fb")
    good.write.parquet(base)
    taken = StorageConfig(path=base, mode="error")
    got = archive_with_fallback(good, taken, batch_id=7)
    assert got.path == f"{base}/fallback/7" and got.fallback and "fallback/7" in caplog.text
    back = spark.read.json(got.path)
    assert back.count() == 2 and "write_timestamp" in back.columns
    # a retry of the same batch replaces its own fallback output
    archive_with_fallback(good, taken, batch_id=7)
    assert spark.read.json(got.path).count() == 2
    fine = archive_with_fallback(good, StorageConfig(path=str(tmp_path / "ok")), batch_id=8)
    assert fine == (str(tmp_path / "ok"), False, None)
    # faults of the frame are no write failures
    with pytest.raises(Exception):
        archive_with_fallback(good.drop("event_time"), taken, batch_id=9)
    with pytest.raises(ValueError):
        archive_with_fallback(good, StorageConfig(path=base, mode="sometimes"), batch_id=9)


def test_formats_that_are_not_there(spark, tmp_path):
    """``delta`` is a data source of its own: without it the write fails, which
    says so, and the fallback takes the batch."""
    good = _good(spark, [message(1), message(2)])
    cfg = StorageConfig(path=str(tmp_path / "d"), fmt="delta")
    with pytest.raises(Exception, match="delta"):
        archive_telemetry(good, cfg)
    got = archive_with_fallback(good, cfg, batch_id="b")
    assert got.fallback and "delta" in got.cause and spark.read.json(got.path).count() == 2


def test_rows_that_cannot_be_computed_are_raised(spark, tmp_path):
    good = _good(spark, [message(1), message(2)])
    broken = good.withColumn("g_force", F.when(F.col("message_id") == 2, F.raise_error(F.lit("bad row"))).otherwise(F.col("g_force")))
    with pytest.raises(Exception, match="bad row"):
        archive_with_fallback(broken, StorageConfig(path=str(tmp_path / "x")), batch_id=1)
    assert not os.path.exists(tmp_path / "x" / "fallback")


@pytest.mark.parametrize("interrupted", [False, True])
def test_restore_fallback(spark, tmp_path, monkeypatch, interrupted):
    """A batch in the fallback joins the archive, once, also if the first
    attempt stopped between its files."""
    good = _good(spark, [message(i, timestamp=f"2024-07-2{i}T10:30:00Z") for i in range(1, 5)])
    base = str(tmp_path / "a")
    cfg = StorageConfig(path=base, partition_cols=("date",))
    archive_telemetry(good.filter("message_id = 1"), cfg)
    taken = StorageConfig(path=base, mode="error", partition_cols=("date",))
    assert archive_with_fallback(good.filter("message_id > 1"), taken, batch_id=7).fallback
    if interrupted:  # one file moved in, then the end
        schema = StructType([*TELEMETRY.fields, StructField("event_time", TimestampType())])
        held = spark.read.schema(schema).json(f"{base}/fallback/7")
        archive_telemetry(held, StorageConfig(path=f"{base}/_restore-7", partition_cols=("date",)))
        day = "date=2024-07-22"
        os.makedirs(f"{base}/{day}", exist_ok=True)
        for f in os.listdir(f"{base}/_restore-7/{day}"):
            os.rename(f"{base}/_restore-7/{day}/{f}", f"{base}/{day}/{f}")
    assert restore_fallback(spark, cfg, 7) == base and restore_fallback(spark, cfg, 7) is None
    back = read_archive(spark, base, ("date",))
    assert sorted((r.message_id, r.date) for r in back.collect()) == [(i, f"2024-07-2{i}") for i in range(1, 5)]
    assert not [f for f in os.listdir(base) if f.startswith("_restore")]


def test_append_alerts(spark, tmp_path):
    good = _good(spark, [message(1, g=4.5), message(2, g=9.0), message(3)])
    path = str(tmp_path / "alerts")
    for _ in range(2):
        append_alerts(accident_alerts(good), path)
    rows = spark.read.parquet(path).collect()
    assert sorted(r.message_id for r in rows) == [1, 1, 2, 2] and {r.alert_type for r in rows} == {"potential_accident"}


def test_reports_partitions_and_published_json(spark, tmp_path):
    df, _ = analysed(spark, [message(1, g=9.0), message(2, g=5.0, speed=30.0)])
    reports, _ = crash_reports(df, "message")
    target = archive_crash_reports(reports, str(tmp_path / "r"))
    assert os.path.isdir(f"{target}/severity_level=CRITICAL/report_date=2024-07-24")
    flat = archive_crash_reports(reports, str(tmp_path / "j"), fmt="json", partitioning_enabled=False)
    assert not [f for f in os.listdir(flat) if "=" in f] and any(f.endswith(".json.gz") for f in os.listdir(flat))
    assert archive_crash_reports(reports, str(tmp_path / "off"), enabled=False) is None
    pub = publish_crash_reports(reports)
    assert all('"accuracy_meters":null' in r.value for r in pub.collect())
    assert pub.columns == ["value"]
    back = spark.read.schema(CRASH_REPORT).json(pub.rdd.map(lambda r: r.value))
    assert back.count() == 2
    assert {r["report_id"] for r in back.collect()} == {"CRASH-TESTPOLICY-1721817000000"}


def test_accident_alerts_strict(spark):
    good = _good(spark, [message(1, g=4.0), message(2, g=4.01)])
    from impactlens.sources.fixture import telemetry  # noqa: F401 (import check)

    got = [r["message_id"] for r in accident_alerts(good).collect()]
    assert got == [2]


def test_max_records_per_file(spark, tmp_path):
    good = _good(spark, [message(i) for i in range(5)])
    path = str(tmp_path / "m")
    archive_telemetry(good, StorageConfig(path=path, partitioning_enabled=False,
                                          max_records_per_file=2))
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) >= 3 and spark.read.parquet(path).count() == 5


def test_null_g_force_is_not_capped_to_100(spark):
    from impactlens.operators.detect import risk_score
    from impactlens.operators.enrich import enrich

    good = _good(spark, [message(1)]).withColumn("g_force", F.lit(None).cast("double"))
    assert risk_score(enrich(good)).collect()[0]["risk_score"] is None
