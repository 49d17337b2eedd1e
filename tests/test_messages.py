"""Streams admitted by messages: limits, spans, restarts, the running trigger."""

import datetime as dt
import json
import os
import time

import pytest
from helpers import message

from impactlens import session
from impactlens.plans import catalog
from impactlens.sources import messages as M
from impactlens.streaming import jobs


def _land(folder, name, lines, end="\n"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"_{name}"), "w", newline="") as f:
        f.write(end.join(lines))
    os.rename(os.path.join(folder, f"_{name}"), os.path.join(folder, name))


def _read(admissions, n, folder):
    reader = M._Reader({"path": folder, "admissions": admissions.log})
    return [v for name, a, b, _ in admissions.spans(n) for batch in reader.read(M.Span(name, a, b))
            for v in batch.column(0).to_pylist()]


def test_spans_hold_whole_messages(tmp_path, monkeypatch):
    """Chunks, several files, CRLF, empty lines, a last line without its end."""
    monkeypatch.setattr(M, "_CHUNK", 7)
    monkeypatch.setattr(M, "MESSAGES_PER_TASK", 3)
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    lines = {"a": [f"first {i}" for i in range(11)] + [""], "b": ["", "x\r", "é" * 9, "y"], "c": ["only"], "d": [""]}
    for name, own in lines.items():
        _land(folder, name, own)
    _land(folder, "_hidden", ["no"])
    found, got = M.Admissions(folder, log), []
    while (n := found.admit(4)) > found.planned:
        spans = found.spans(n)
        assert 1 <= sum(m for *_, m in spans) <= 4 and all(m <= 3 for *_, m in spans)
        own = _read(found, n, folder)
        assert len(own) == sum(m for *_, m in spans)
        got += own
        found.take(n)
        found.done(n)
    # "" at the end of a joined file means that its last line has an end.
    assert got == [f"first {i}" for i in range(11)] + ["", "x", "é" * 9, "y", "only"]


def test_offered_again_until_planned_and_files_that_grow(tmp_path, monkeypatch):
    monkeypatch.setattr(M, "SNAPSHOT", 2)
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    _land(folder, "a", ["1", "2", "3", ""])
    first = M.Admissions(folder, log)
    assert first.admit(2) == first.admit(2) == 1
    again = M.Admissions(folder, log)  # a restart before Spark took it
    assert again.admit(2) == 1 and again.spans(1) == [["a", 0, 4, 2]]
    again.take(1)
    later = M.Admissions(folder, log)  # a restart after Spark took it
    assert later.admit(2) == 2 and later.spans(2) == [["a", 4, 6, 1]]
    later.take(2)
    assert later.admit(2) == 2  # nothing new
    with open(os.path.join(folder, "a"), "a") as f:
        f.write("4\n5\n6\n")
    later.done(2)
    assert not os.path.exists(f"{log}/1.json") and os.path.exists(f"{log}/2.state")
    last = M.Admissions(folder, log)
    assert last.admit(2) == 3 and last.spans(3) == [["a", 6, 10, 2]]


def test_compressed_files_are_refused(tmp_path):
    _land(str(tmp_path / "in"), "a.json.gz", ["x"])
    with pytest.raises(ValueError, match="compressed"):
        M.Admissions(str(tmp_path / "in"), str(tmp_path / "log")).admit(1)


def test_empty_and_missing_folders(tmp_path):
    assert M.Admissions(str(tmp_path / "none"), str(tmp_path / "log")).admit(5) == 0


def test_stop_and_restart(spark, tmp_path):
    """Every message once, at most 7 a batch, over a stop and new files."""
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    _land(src, "a.json", [json.dumps(message(i, g=9.0 if i % 5 == 0 else 1.0)) for i in range(40)])

    def go(stop_after=None):
        h = jobs.start_crash_fanout(spark, src, out, ckpt, max_messages_per_trigger=7, interval="0 seconds")
        if stop_after:
            until = time.time() + 120
            while len(h.metrics()) < stop_after and time.time() < until:
                time.sleep(0.05)
            h.query.stop()
        else:
            h.drain()
        return h

    go(stop_after=2)
    h = go()
    assert [m["messages"] for m in h.metrics()] == [7, 7, 7, 7, 7, 5]
    _land(src, "0.json", [json.dumps(message(i, g=9.0)) for i in range(40, 43)])
    h = go()
    assert [m["messages"] for m in h.metrics()][6:] == [3]
    got = spark.read.parquet(h.telemetry).select("message_id").collect()
    assert sorted(r[0] for r in got) == list(range(43))
    assert sorted(r[0] for r in spark.read.parquet(h.reports).select("message_id").collect()) == [*range(0, 40, 5), 40, 41, 42]


def test_limits_that_exclude_each_other(spark, tmp_path):
    frame = spark.readStream.format("text").load(str(tmp_path))
    for source, options in ((frame, {"max_messages_per_trigger": 5}), (frame, {"max_files_per_trigger": 1}),
                            (str(tmp_path), {"max_messages_per_trigger": 5, "available_now": True}),
                            (str(tmp_path), {"max_messages_per_trigger": 5, "max_files_per_trigger": 5})):
        with pytest.raises(ValueError):
            jobs.start_crash_fanout(spark, source, str(tmp_path / "o"), str(tmp_path / "c"), **options)


def test_running_trigger(spark, tmp_path):
    """A batch every two seconds while messages land."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _land(src, "a.json", [json.dumps(message(1, g=9.0))])
    q = jobs.start_report_feed(spark, src, out, str(tmp_path / "c"), max_files_per_trigger=1)
    try:
        q.processAllAvailable()
        _land(src, "b.json", [json.dumps(message(2, g=9.0)), json.dumps(message(3))])
        _land(src, "c.json", [json.dumps(message(4, g=9.0))])
        q.processAllAvailable()
        assert q.isActive
        starts = [p["timestamp"] for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()
    seconds = [int(t[17:19]) for t in starts]
    # Triggers lie on whole intervals.
    assert len(starts) == 3 and (seconds[2] - seconds[1]) % 60 >= 2 and all(s % 2 == 0 for s in seconds[1:])
    assert len(spark.read.text(out).collect()) == 3


def test_shares_make_the_batches_of_one_stream(spark, tmp_path, monkeypatch):
    """Shares cut within files, at their ends and past empty ones; what comes or
    grows later is admitted by one of them."""
    monkeypatch.setattr(M, "SNAPSHOT", 2)
    folder = str(tmp_path / "in")
    for name, n in {"a": 11, "b": 0, "c": 5, "d": 8, "e": 9}.items():
        _land(folder, name, [f"{name} {i}" for i in range(n)] + ([""] if name != "e" else []))

    def batches(name, share, most=4):
        got = []
        while True:  # a restart before every batch
            found = M.Admissions(folder, str(tmp_path / name), share.begin, share.stop)
            n = found.admit(most)
            if n == found.planned:
                return got
            got.append(_read(found, n, folder))
            found.take(n)
            found.done(n)

    whole = batches("whole", M.Share())
    assert [len(b) for b in whole] == [4] * 8 + [1]
    for most, least, firsts in ((3, 1, [0, 3, 6]), (9, 1, list(range(9))), (9, 2, [0, 2, 4, 6, 8]), (1, 1, [0])):
        cut = M.shares(spark, folder, most, least, 4)
        assert [s.first for s in cut] == firsts and sum(s.batches for s in cut) == 9
        own = [batches(f"{most}-{least}-{s.first}", s) for s in cut]
        assert [len(b) for b in own] == [s.batches for s in cut] and sum(own, []) == whole
    cut = M.shares(spark, folder, 3, 1, 4)
    _land(folder, "aa", ["late"])
    with open(os.path.join(folder, "d"), "a") as f:
        f.write("grown\n")
    more = [batches(f"3-1-{s.first}", s) for s in cut]
    assert sorted(sum(sum(more, []), [])) == ["grown", "late"]
    os.makedirs(tmp_path / "empty")
    assert M.shares(spark, str(tmp_path / "empty"), 3) == [M.Share()]


def test_admission_by_streams_side_by_side(spark, tmp_path, monkeypatch):
    """A hundred messages a micro-batch, numbered as by one stream, while the
    shares of the folder run at once."""
    start = dt.datetime(2024, 1, 3)
    spark.createDataFrame([(i * 3, start + dt.timedelta(seconds=i), i % 9) for i in range(1350)], "event_id long, ts timestamp, user_id long") \
        .write.parquet(str(tmp_path / "events.parquet"))
    drained, running = catalog.drain, []

    def drain(*queries):
        running.extend(q.isActive for q in queries)
        drained(*queries)

    monkeypatch.setattr(catalog, "drain", drain)
    rows = sorted(catalog.QUERIES["stream_admission"](spark, str(tmp_path)).collect())
    assert [tuple(r) for r in rows] == [(k, n, n, 300 * k, 3 * (100 * k + n - 1)) for k, n in [*((k, 100) for k in range(13)), (13, 50)]]
    assert len(running) == 4 and all(running)


def test_admission_keeps_light_checkpoints(spark, tmp_path, monkeypatch):
    """A thousand small batches start no process for every file of a local
    checkpoint; a class that was chosen stays."""
    start = dt.datetime(2024, 1, 3)
    spark.createDataFrame([(i, start + dt.timedelta(seconds=i), i % 9) for i in range(250)], "event_id long, ts timestamp, user_id long") \
        .write.parquet(str(tmp_path / "events.parquet"))
    key, drained, seen = "spark.sql.streaming.checkpointFileManagerClass", catalog.drain, []

    def drain(*queries):
        seen.append(spark.conf.get(key, None))
        drained(*queries)

    monkeypatch.setattr(catalog, "drain", drain)
    rows = sorted(catalog.QUERIES["stream_admission"](spark, str(tmp_path)).collect())
    assert [tuple(r)[:2] for r in rows] == [(0, 100), (1, 100), (2, 50)]
    assert seen[0].endswith(".FileSystemBasedCheckpointFileManager") and spark.conf.get(key, None) is None
    chosen = seen[0].replace("FileSystemBased", "FileContextBased")
    spark.conf.set(key, chosen)
    try:
        with session.light_checkpoints(spark, str(tmp_path)):
            assert spark.conf.get(key) == chosen
        assert spark.conf.get(key) == chosen
    finally:
        spark.conf.unset(key)
