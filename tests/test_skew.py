"""A vehicle with most of the rows: the magnetic baseline join, forced to a
sort-merge join (no broadcast), must give the brute-force answer and split
the vehicle, with or without message ids."""

import random

import pytest
from pyspark.sql import functions as F

from impactlens.operators.reconcile import magnetic_anomalies
from impactlens.operators.trips import trip_distance

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


@pytest.mark.parametrize("ids", [True, False])
def test_magnetic_anomalies_under_skew(spark, ids):
    rnd = random.Random(3)
    rows = []
    for mid in range(3000):
        vin = "HOT" if mid % 10 else None if mid % 70 == 0 else f"V{mid % 7}"
        mag = rnd.gauss(60, 10) if rnd.random() > 0.02 else 200.0
        rows.append((mid if ids else None, vin, mag))
    rows.append((5000 if ids else None, None, 400.0))
    df = (spark.createDataFrame(rows, "message_id long, vin string, mag_magnitude double").repartition(8)
          .withColumn("has_magnetometer", F.lit(True)))
    saved = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        out = magnetic_anomalies(df, threshold=50.0)
        got = sorted((r["vin"] or "", r["mag_magnitude"]) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    base = {}
    for _, vin, mag in rows:
        base.setdefault(vin, []).append(mag)
    want = sorted((vin or "", mag) for _, vin, mag in rows
                  if abs(mag - sum(base[vin]) / len(base[vin])) > 50.0)
    assert got == want and len(want) > 0 and any(vin == "" for vin, _ in want)
    assert "SortMergeJoin" in plan and "skew=true" in plan


def test_unknown_vehicles_form_no_trip(spark):
    rows = [(i, None if i % 2 else "A", f"2024-01-01 00:00:{i:02d}", 33.0 + i, -84.0) for i in range(10)]
    df = spark.createDataFrame(rows, "message_id long, vin string, t string, gps_lat double, gps_lon double")
    df = df.withColumn("event_time", F.col("t").cast("timestamp")).withColumn("has_gps", F.lit(True))
    got = {r["vin"]: r for r in trip_distance(df.drop("t")).collect()}
    assert (got[None]["fixes"], got[None]["segments"], got[None]["total_distance_m"]) == (5, 0, 0.0)
    assert (got["A"]["fixes"], got["A"]["segments"]) == (5, 4)
