"""Ordered landing folders: files in order, each of a bounded number of messages."""

import datetime as dt
import glob
import json
import random

import pytest

from impactlens.plans import catalog


@pytest.mark.parametrize("parts,by", [(1, "message_id"), (4, "event_time")])
def test_files_do_not_grow_with_the_table(spark, tmp_path, monkeypatch, parts, by):
    monkeypatch.setattr(catalog, "MESSAGES_PER_FILE", 100)
    ids = list(range(1000))
    random.Random(4).shuffle(ids)
    start = dt.datetime(2024, 1, 3)
    spark.createDataFrame([(i, start + dt.timedelta(seconds=7 * i), i % 9) for i in ids], "event_id long, ts timestamp, user_id long") \
        .write.parquet(str(tmp_path / "events.parquet"))
    files = sorted(glob.glob(f"{catalog._ordered_landing(spark, str(tmp_path), parts, by)}/part-*"))
    held = [[json.loads(line)["message_id"] for line in open(f)] for f in files]
    got = [i for own in held for i in own]
    assert sorted(got) == list(range(1000)) and max(map(len, held)) <= 300
    if by == "message_id":
        assert got == sorted(got)
