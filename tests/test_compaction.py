"""Compaction of a stream's archive: same rows, fewer files, readers undisturbed."""

import glob
import json
import os

from helpers import message

from impactlens.sources.compaction import compact_days, read_stream_archive, remove_superseded
from impactlens.streaming.jobs import start_crash_fanout


def _stream(spark, tmp_path, name, docs):
    src = str(tmp_path / "src")
    os.makedirs(src, exist_ok=True)
    for i, d in enumerate(docs):
        with open(f"{src}/{name}{i}.json", "w") as f:
            f.write(json.dumps(d))
    h = start_crash_fanout(spark, src, str(tmp_path / "out"), str(tmp_path / "ckpt"), available_now=True, max_files_per_trigger=1)
    h.await_all()
    return h.telemetry


def _ids(df):
    return sorted(r[0] for r in df.select("message_id").collect())


def _files(path, day):
    return len(glob.glob(f"{path}/**/date={day}/*.parquet", recursive=True))


def test_compaction(spark, tmp_path):
    stamp = "2024-07-2{}T10:30:00Z"
    path = _stream(spark, tmp_path, "a", [message(i, timestamp=stamp.format(i % 3)) for i in range(6)])
    assert compact_days(spark, path, "2024-07-20") == 0 and _ids(read_stream_archive(spark, path)) == list(range(6))
    before = read_stream_archive(spark, path)
    assert compact_days(spark, path, "2024-07-22") == 2
    assert _ids(read_stream_archive(spark, path)) == list(range(6))
    assert compact_days(spark, path, "2024-07-22") == 0

    # Late rows for a day that is over, and one of an open day.
    _stream(spark, tmp_path, "b", [message(10, timestamp=stamp.format(0)), message(11, timestamp=stamp.format(2))])
    now = read_stream_archive(spark, path)
    assert _ids(now) == [*range(6), 10, 11] and dict(now.groupBy("date").count().collect())["2024-07-20"] == 3
    assert compact_days(spark, path, "2024-07-22") == 1
    assert _ids(before) == list(range(6))  # a reader of before the compaction

    os.makedirs(f"{path}/_generations/99")  # a compaction that failed at its last step
    remove_superseded(spark, path)
    after = read_stream_archive(spark, path)
    assert _ids(after) == [*range(6), 10, 11]
    assert {r.message_id: (r.date, r.month) for r in after.collect()}[10] == ("2024-07-20", "07")
    assert _files(path, "2024-07-20") == _files(path, "2024-07-21") == 1 and _files(path, "2024-07-22") == 3


def test_files_are_bounded_by_bytes(spark, tmp_path):
    path = str(tmp_path / "t")
    from impactlens.sources.sinks import telemetry_for_archive
    from impactlens.sources.fixture import telemetry
    from impactlens.sources.ingest import prepare

    good, _ = prepare(telemetry(spark, "/root/testdata/sf0.01"))
    rows = telemetry_for_archive(good).filter("date < '2024-01-04'").cache()
    n = rows.count()
    for batch in range(4):
        (rows.filter(f"message_id % 4 = {batch}").repartition(3).write.partitionBy("date").parquet(f"{path}/batch_id={batch}"))
    assert _files(path, "2024-01-02") == 12
    days = compact_days(spark, path, "2024-01-04", 32 << 20)
    assert days == 3 and len(glob.glob(f"{path}/_compact/*/date=*/*.parquet")) == 3
    assert read_stream_archive(spark, path).count() == n
