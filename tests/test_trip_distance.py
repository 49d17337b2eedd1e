"""Trip distance from mergeable summaries against a brute-force pandas
version on a small fixture where one vehicle holds most rows, many fixes share
one timestamp, and some messages are exact copies (same id and time)."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from impactlens.operators import trips


def _haversine(lat1, lon1, lat2, lon2):
    la1, la2 = math.radians(lat1), math.radians(lat2)
    dlat, dlon = math.radians(lat2 - lat1), math.radians(lon2 - lon1)
    a = math.sin(dlat / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin(dlon / 2) ** 2
    return 6371000.0 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def fixture(spark):
    rnd = random.Random(7)
    rows = []
    mid = 0
    for vin, n in (("HOT", 600), ("A", 40), ("B", 3), ("C", 1)):
        t = 1_700_000_000
        for _ in range(n):
            t += rnd.choice([0, 0, 0, 1, 2, 5, 13, 61, 300])   # bursts and gaps
            row = (mid, vin, t, 33.7 + rnd.random() / 10, -84.4 + rnd.random() / 10,
                   rnd.random() < 0.05)
            rows.append(row)
            if vin == "HOT" and rnd.random() < 0.2:   # exact copies of a message
                rows.extend([row] * rnd.randint(1, 5))
            mid += 1
    pdf = pd.DataFrame(rows, columns=["message_id", "vin", "t", "lat", "lon", "no_gps"])
    df = (spark.createDataFrame(pdf)
          .withColumn("event_time", F.timestamp_seconds("t"))
          .withColumn("sensors", F.struct(
              F.when(~F.col("no_gps"), F.struct(F.col("lat").alias("lat"),
                                                F.col("lon").alias("lon"))).alias("gps")))
          .withColumn("gps_lat", F.col("sensors.gps.lat"))
          .withColumn("gps_lon", F.col("sensors.gps.lon"))
          .withColumn("has_gps", F.col("sensors.gps").isNotNull()))
    return pdf, df


def check(pdf, found):
    got = {r["vin"]: r for r in found.collect()}
    want = {}
    fixes = pdf[~pdf.no_gps].sort_values(["vin", "t", "message_id"])
    for vin, g in fixes.groupby("vin"):
        pts = list(zip(g.lat, g.lon))
        segs = [_haversine(*pts[i - 1], *pts[i]) for i in range(1, len(pts))]
        want[vin] = (len(pts), len(segs), sum(segs), max(segs) if segs else None)
    assert set(got) == set(want)
    for vin, (n, s, total, mx) in want.items():
        r = got[vin]
        assert r["fixes"] == n and r["segments"] == s
        assert r["total_distance_m"] == pytest.approx(total, rel=1e-12, abs=1e-6)
        if mx is None:
            assert r["max_segment_m"] is None
        else:
            assert r["max_segment_m"] == pytest.approx(mx, rel=1e-12)


@pytest.mark.parametrize("seconds", [1, 60, 600, 10**6])
def test_matches_brute_force(spark, seconds):
    pdf, df = fixture(spark)
    check(pdf, trips.trip_distance(df, seconds))


@pytest.mark.parametrize("in_order", [True, False])
def test_summaries_of_batches_merge(spark, tmp_path, in_order):
    """Batches in order of time, and rows dealt to batches by chance."""
    pdf, df = fixture(spark)
    fixes = trips.fixes_of(df)
    ranks = pdf["t"].rank(method="first")
    cut = pdf["t"].iloc[int(ranks.sort_values().index[len(pdf) // 2])]
    part = (F.unix_micros("t") < int(cut) * 1_000_000).cast("int") if in_order else F.pmod("mid", F.lit(3))
    batches = [fixes.filter(part == k) for k in range(3)]
    summaries = [trips.summarise(b) for b in batches]
    stored = summaries[0].unionByName(summaries[1]).unionByName(summaries[2])
    stored.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    mixed = trips.interleaved(stored).count()
    assert mixed == 0 if in_order else mixed > 0
    check(pdf, trips.distances(trips.extended(stored, fixes), trips.unknown_fixes(fixes)))


def test_positions_that_are_no_numbers(spark):
    rows = [("A", 1, float("nan")), ("A", 2, 1.0), ("A", 3, 1.0), ("B", 1, 1.0)]
    df = (spark.createDataFrame(rows, "vin string, message_id long, gps_lat double")
          .selectExpr("*", "timestamp_seconds(message_id) AS event_time", "0D AS gps_lon", "true AS has_gps",
                      "named_struct('gps', named_struct('lat', gps_lat, 'lon', 0D)) AS sensors"))
    got = {r["vin"]: r for r in trips.trip_distance(df).collect()}
    assert math.isnan(got["A"]["total_distance_m"]) and got["A"]["segments"] == 2
    assert got["B"]["total_distance_m"] == 0.0 and trips.trip_distance(df.limit(0)).count() == 0
