"""Rows of the sorted reports come in their order, ties included."""

from impactlens.plans.catalog import QUERIES

NONE_FIRST = lambda v: (v is not None, v)


def test_triage(spark, sf_small):
    rows = QUERIES["crash_triage"](spark, sf_small).collect()
    keys = [(r.severity_priority, -r.g_force, r.message_id) for r in rows]
    assert len(rows) > 20 and keys == sorted(keys)


def test_patterns(spark, sf_small):
    rows = QUERIES["crash_patterns"](spark, sf_small).collect()
    keys = [(-r.gyro_magnitude, -r.total_g_force, r.message_id) for r in rows]
    assert len(rows) > 20 and keys == sorted(keys)


def test_storage_and_days(spark, sf_small):
    rows = QUERIES["storage_stats"](spark, sf_small).collect()
    by_day = {}
    for r in rows:
        by_day.setdefault(r.date, []).append((-r.record_count, NONE_FIRST(r.policy_id)))
    assert list(by_day) == sorted(by_day, reverse=True) and all(v == sorted(v) for v in by_day.values())
    for name in ("daily_counts", "archive_daily_counts"):
        days = [r.date for r in QUERIES[name](spark, sf_small).collect()]
        assert len(days) > 5 and days == sorted(days, reverse=True)
