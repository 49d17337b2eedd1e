"""Physical-plan shape: pruning, no needless shuffles, partial aggregation."""

import re

import pytest

import __spark_entry__ as entry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _hash_exchanges(plan):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def test_scan_reads_only_needed_columns(spark, sf_small):
    plan = _plan(entry.queries()["crashes_message"](spark, sf_small))
    m = re.search(r"ReadSchema: struct<([^>]*)>", plan)
    assert m and set(re.findall(r"(\w+):", m.group(1))) == {"event_id", "ts", "user_id"}


@pytest.mark.parametrize("name", ["crashes_message", "crash_reports_flat", "crash_alerts",
                                  "accident_alerts", "json_ingest"])
def test_row_level_jobs_do_not_shuffle_by_key(spark, sf_small, name):
    assert _hash_exchanges(_plan(entry.queries()[name](spark, sf_small))) == []


def test_aggregations_combine_map_side(spark, sf_small):
    plan = _plan(entry.queries()["driving_stats"](spark, sf_small))
    assert "partial_sum" in plan and "partial_count" in plan
    assert len(_hash_exchanges(plan)) == 1


def test_no_query_deals_rows_round_robin(spark, sf_small):
    from impactlens.plans.catalog import QUERIES

    for name in ("crashes_message", "quarantine", "magnetic_anomalies", "driving_stats", "trip_distance"):
        assert "RoundRobin" not in _plan(QUERIES[name](spark, sf_small))


def test_quarantine_reads_once(spark, sf_small):
    plan = _plan(entry.queries()["quarantine"](spark, sf_small))
    assert plan.count("FileScan") == 1 and _hash_exchanges(plan) == []


def test_trip_distance_shuffles(spark, sf_small):
    """All fixes are exchanged once, by (vin, bucket), and none is sampled;
    what follows are summaries: by (vin, day), by vin, and one count of the
    fixes without a vin."""
    plan = _plan(entry.queries()["trip_distance"](spark, sf_small))
    assert "rangepartitioning" not in plan
    ex = _hash_exchanges(plan)
    assert len(ex) == 3 and sum("bucket" in e for e in ex) == 1 and sum("day" in e for e in ex) == 1


def test_sql_functions_are_inlined(spark, sf_small):
    df = entry.queries()["crash_patterns"](spark, sf_small)
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    assert "calculateTotalGForce" not in opt and "SQRT" in opt.upper()


def test_archive_reads_prune_and_push_down(spark, tmp_path):
    from pyspark.sql import functions as F

    from impactlens.config import StorageConfig
    from impactlens.plans.catalog import good_rows
    from impactlens.sources.sinks import accident_alerts, archive_telemetry, read_archive

    path = str(tmp_path / "arch")
    parts = ("year", "month", "date")
    archive_telemetry(good_rows(spark, "/root/testdata/sf0.001"),
                      StorageConfig(path=path, partition_cols=parts))
    back = read_archive(spark, path, parts)
    week = back.filter(F.col("date").between("2024-01-08", "2024-01-14"))
    alerts = accident_alerts(week)
    plan = _plan(alerts)
    assert re.search(r"PartitionFilters: \[[^\]]*date", plan)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(g_force,4\.0\)", plan)
    got = alerts.collect()
    assert got and all("2024-01-08" <= r["event_time_utc"][:10] <= "2024-01-14" for r in got)


def test_daily_counts_come_from_footers(spark, sf_small):
    """The scan returns counts, not rows: one aggregated row per file."""
    df = entry.queries()["archive_daily_counts"](spark, sf_small)
    plan = _plan(df)
    assert re.search(r"PushedAggregation: \[COUNT\(\*\)\]", plan) and re.search(r"PushedGroupBy: \[date\]", plan)
    held = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert "parquet" in held and df.count() > 5
