"""Streaming fan-out: equals batch, exactly once across restarts, metrics."""

import json
import os

from helpers import message

from impactlens.streaming.jobs import start_crash_fanout


def _write(path, name, docs):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(json.dumps(d) if not isinstance(d, str) else d for d in docs) + "\n")


def _run(spark, src, out, ckpt):
    h = start_crash_fanout(spark, src, out, ckpt, available_now=True)
    h.await_all()
    return h


def test_fan_out_and_restart(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    _write(src, "a.json", [message(1, g=9.0), message(2), message(3, timestamp="junk"),
                           "not json", message(4, g=9.0, policy_id=None)])
    h = _run(spark, src, out, ckpt)
    reports = spark.read.parquet(f"{out}/reports")
    assert [r["message_id"] for r in reports.collect()] == [1]
    assert spark.read.parquet(f"{out}/telemetry").count() == 3
    reasons = sorted(r["reason"] for r in spark.read.parquet(f"{out}/quarantine").collect())
    assert reasons == ["bad_timestamp", "malformed_json", "report_missing_policy_id"]
    assert h.metrics()[0] == {"messages": 5, "crashes": 2}

    # restart on the same checkpoint: nothing is reprocessed
    _run(spark, src, out, ckpt)
    assert spark.read.parquet(f"{out}/reports").count() == 1
    assert spark.read.parquet(f"{out}/telemetry").count() == 3

    # new data: only the new file is processed
    _write(src, "b.json", [message(5, g=9.0)])
    _run(spark, src, out, ckpt)
    assert sorted(r["message_id"] for r in spark.read.parquet(f"{out}/reports").collect()) == [1, 5]
    assert spark.read.parquet(f"{out}/telemetry").count() == 4


def test_metrics_of_every_batch(spark, tmp_path):
    """More micro-batches than the query keeps progress updates of, and a restart."""
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(kept, "2")
    try:
        for i in range(5):
            _write(src, f"{i}.json", [message(10 * i + k, g=9.0 if k else 1.0) for k in range(2)])
        h = start_crash_fanout(spark, src, out, ckpt, available_now=True, max_files_per_trigger=1)
        h.await_all()
        assert h.metrics() == [{"messages": 2, "crashes": 1}] * 5
        _write(src, "z.json", [message(99)])
        assert _run(spark, src, out, ckpt).metrics() == [{"messages": 2, "crashes": 1}] * 5 + [{"messages": 1, "crashes": 0}]
    finally:
        spark.conf.unset(kept)


def test_streaming_frame_and_thresholds(spark, tmp_path):
    """A streaming DataFrame as the source; tuned thresholds reach every job."""
    from impactlens.config import Thresholds
    from impactlens.streaming.jobs import read_windowed_stats, start_windowed_stats

    src = str(tmp_path / "src")
    _write(src, "a.json", [message(1, g=3.0), message(2, g=5.0), message(3, ax=30.0)])
    frame = spark.readStream.format("text").load(src)
    low = Thresholds(g_force=2.5)
    h = start_crash_fanout(spark, frame, str(tmp_path / "o"), str(tmp_path / "c"), available_now=True, thr=low)
    h.await_all()
    assert sorted(r["message_id"] for r in spark.read.parquet(h.reports).collect()) == [1, 2, 3]
    for thr, count in ((Thresholds(), 2), (Thresholds(g_force=1.0), 0)):
        out = str(tmp_path / f"w{count}")
        frame = spark.readStream.format("text").load(src)
        start_windowed_stats(spark, frame, out, out + "-c", available_now=True, thr=thr).awaitTermination()
        assert sum(r["message_count"] for r in read_windowed_stats(spark, out).collect()) == count


def test_windows_are_complete_over_batches(spark, tmp_path):
    from impactlens.streaming.jobs import read_windowed_stats, start_windowed_stats

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _write(src, "a.json", [message(1, speed=10.0)])
    _write(src, "b.json", [message(2, speed=20.0), message(3, speed=20.0, timestamp="2024-07-24T10:39:00Z")])
    start_windowed_stats(spark, src, out, str(tmp_path / "c"), available_now=True,
                         max_files_per_trigger=1).awaitTermination()
    got = sorted((r["message_count"], r["avg_speed"]) for r in read_windowed_stats(spark, out).collect())
    assert got == [(1, 20.0), (2, 15.0)]


def test_stream_equals_batch_query(spark, sf_small):
    import __spark_entry__ as entry

    q = entry.queries()
    stream = q["stream_equals_batch"](spark, sf_small)
    batch = q["crash_reports_flat"](spark, sf_small)
    assert stream.count() == batch.count() > 0
    assert stream.exceptAll(batch.select(stream.columns)).count() == 0


def test_foreach_batch_bounded_batches(spark, tmp_path):
    from impactlens.streaming.jobs import start_foreach_batch

    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    _write(src, "a.json", [message(1, g=9.0), message(2, g=4.5)])
    _write(src, "b.json", [message(3, g=9.0), message(4)])

    def handler(reports, alerts, batch_id):
        reports.drop("processed_timestamp").write.mode("overwrite").parquet(f"{out}/reports/b={batch_id}")
        alerts.write.mode("overwrite").parquet(f"{out}/alerts/b={batch_id}")

    q = start_foreach_batch(spark, src, handler, ckpt, available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 2
    assert sorted(r["message_id"] for r in spark.read.parquet(f"{out}/reports").collect()) == [1, 2, 3]
    assert sorted(r["message_id"] for r in spark.read.parquet(f"{out}/alerts").collect()) == [1, 2, 3]


def test_report_feed_writes_json_documents(spark, tmp_path):
    from impactlens.schema import CRASH_REPORT
    from impactlens.streaming.jobs import start_report_feed

    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    _write(src, "a.json", [message(1, g=9.0), message(2), message(3, g=6.5, speed=2.0)])
    start_report_feed(spark, src, out, ckpt, available_now=True).awaitTermination()
    docs = spark.read.schema(CRASH_REPORT).json(out).collect()
    assert sorted(d["crash_type"] for d in docs) == ["HIGH_G_FORCE", "SUDDEN_STOP"]
    assert all(d["report_id"] == "CRASH-TESTPOLICY-1721817000000" for d in docs)


def test_late_rows_reach_their_windows(spark, tmp_path):
    """Rows days behind the latest one, a batch that runs again, NaN and null."""
    from impactlens.streaming.jobs import read_window_parts, start_window_parts, windowed_driving_stats
    from impactlens.operators.detect import analyse
    from impactlens.sources.ingest import parse_telemetry, prepare

    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    days = ["2024-07-24T10:30:00Z", "2024-07-29T10:30:10Z", "2024-07-24T10:30:05Z", "2024-07-20T00:00:00Z", "2024-07-24T10:30:29Z"]
    for i, day in enumerate(days):
        _write(src, f"{i}.json", [message(10 * i + k, speed=10.1 * k, g=1.0 + k / 7, timestamp=day) for k in range(4)]
               + [message(10 * i + 5, timestamp=day, policy_id=None)])
    for _ in range(2):
        start_window_parts(spark, src, out, ckpt, available_now=True, max_files_per_trigger=1).awaitTermination()
    good, _ = prepare(parse_telemetry(spark.read.text(src)))
    want = windowed_driving_stats(analyse(good, "batch"), watermark=None)
    got = read_window_parts(spark, out).select(want.columns)
    assert got.count() == want.count() == 6 and got.exceptAll(want).count() == 0
    # The last batch again, as after a failure: it replaces its own part.
    for name in ("4", ".4.crc"):
        os.remove(os.path.join(ckpt, "commits", name))
    start_window_parts(spark, src, out, ckpt, available_now=True, max_files_per_trigger=1).awaitTermination()
    assert read_window_parts(spark, out).select(want.columns).exceptAll(want).count() == 0
