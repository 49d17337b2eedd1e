"""Property check of event-time parsing: ISO-8601 instants (offsets,
0-9 fraction digits, optional seconds, either case) and epoch-second
strings, against Python's own arithmetic."""

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from impactlens.sources.ingest import with_event_time

UTC = dt.timezone.utc


@st.composite
def iso_texts(draw):
    t = draw(st.datetimes(min_value=dt.datetime(1971, 1, 1), max_value=dt.datetime(2100, 1, 1)))
    digits = draw(st.integers(0, 9))
    with_seconds = draw(st.booleans()) or digits > 0
    offset_min = draw(st.sampled_from([None, 0, 120, -300, 330]))
    text = t.strftime("%Y-%m-%dT%H:%M")
    frac_ns = 0
    if with_seconds:
        text += t.strftime(":%S")
        if digits:
            frac = f"{t.microsecond:06d}{draw(st.integers(0, 999)):03d}"[:digits]
            text += "." + frac
            frac_ns = int(frac.ljust(9, "0"))
    if offset_min is None:
        text += "Z"
        off = 0
    else:
        sign = "+" if offset_min >= 0 else "-"
        text += f"{sign}{abs(offset_min) // 60:02d}:{abs(offset_min) % 60:02d}"
        off = offset_min
    if draw(st.booleans()):
        text = text.lower()
    base = dt.datetime(t.year, t.month, t.day, t.hour, t.minute,
                       t.second if with_seconds else 0, tzinfo=UTC)
    epoch_s = int(base.timestamp()) - off * 60
    return text, epoch_s * 1_000_000 + frac_ns // 1000


@st.composite
def epoch_texts(draw):
    secs = draw(st.integers(0, 4_000_000_000))
    frac = draw(st.integers(0, 999_999_999))
    text = f"{secs}.{frac:09d}"
    d = float(text)
    whole = math.trunc(d)
    nanos = math.trunc((d - whole) * 1e9)
    return text, whole * 1_000_000 + math.floor(nanos / 1000)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(iso_texts(), epoch_texts()), min_size=60, max_size=60))
def test_event_time_matches_python(spark, cases):
    df = spark.createDataFrame([(t,) for t, _ in cases], "timestamp string")
    got = [r["us"] for r in with_event_time(df).select(
        F.unix_micros("event_time").alias("us")).collect()]
    assert got == [us for _, us in cases]
