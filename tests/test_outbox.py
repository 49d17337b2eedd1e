"""The committing sink: what readers see after failures of every kind."""

import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from impactlens.sources import outbox as O


def _write(spark, src, out, ckpt, fail=None):
    docs = spark.readStream.schema("value string").option("maxFilesPerTrigger", "1").text(src)
    if fail:
        docs = docs.select(F.when(F.col("value") == fail, F.raise_error(F.lit("lost"))).otherwise(F.col("value")).alias("value"))
    O.write_outbox(docs, out, ckpt, {"availableNow": True}).awaitTermination()


def _land(src, name, lines):
    os.makedirs(src, exist_ok=True)
    with open(f"{src}/{name}", "w") as f:
        f.write("\n".join(lines))


def _seen(spark, out):
    return sorted((r.batch, r.value) for r in O.published(spark, out).collect())


def test_failed_and_repeated_batches(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    _land(src, "a", ["a1", "a2"])
    _write(spark, src, out, ckpt)
    assert _seen(spark, out) == [(0, "a1"), (0, "a2")]
    _land(src, "b", ["b1", "b2", "b3"])
    with pytest.raises(StreamingQueryException):
        _write(spark, src, out, ckpt, fail="b3")
    assert _seen(spark, out) == [(0, "a1"), (0, "a2")]
    _write(spark, src, out, ckpt)  # the failed batch again
    want = [(0, "a1"), (0, "a2"), (1, "b1"), (1, "b2"), (1, "b3")]
    assert _seen(spark, out) == want
    # Spark lost its own commit after the sink had committed: published once.
    for name in ("1", ".1.crc"):
        os.remove(os.path.join(ckpt, "commits", name))
    _write(spark, src, out, ckpt)
    assert _seen(spark, out) == want
    listed = [f for n in ("0", "1") for f, _ in json.load(open(f"{out}/commits/{n}.json"))["files"]]
    assert len(listed) == len(set(listed))


def test_strays_are_not_seen(spark, tmp_path):
    """A file of a task that ran twice, a commit that was not finished."""
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    _land(src, "a", ["a1"])
    _write(spark, src, out, ckpt)
    _land(f"{out}/data", "stray.json", ["no"])
    _land(f"{out}/commits", "_7-x", [json.dumps({"batch": 7, "files": [["stray.json", 1]]})])
    assert _seen(spark, out) == [(0, "a1")]


def test_large_and_empty_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(O, "_BYTES", 10)
    w = O._Writer(str(tmp_path))
    rows = [(f"document {i}",) for i in range(7)] + [(None,)]
    done, none = w.write(iter(rows)), w.write(iter([]))
    assert (done.rows, none) == (8, O.Written(None, 0))
    w.commit([done, none, None], 3)
    assert open(tmp_path / "data" / done.file).read().splitlines() == [v or "" for v, in rows]
    again = w.write(iter(rows))
    w.commit([again], 3)
    assert not os.path.exists(tmp_path / "data" / again.file)
    lost = w.write(iter(rows))
    w.abort([lost, None], 4)
    assert os.listdir(tmp_path / "data") == [done.file]
