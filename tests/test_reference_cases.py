"""The four reference unit-test messages and the values derived from them."""

import pytest
from helpers import analysed, by_id, message

from impactlens.operators.report import crash_reports

# The sensors all four messages share.
SENSORS = {
    "gps": {"lat": 40.7128, "lon": -74.0060, "altitude": 0.0, "speed": 15.0, "bearing": 45.0,
            "accuracy": 5.0, "satellite_count": 8, "fix_time": "2024-07-24T10:30:00Z"},
    "gyroscope": {"x": 0.0, "y": 0.0, "z": 0.0},
    "magnetometer": {"x": 23.0, "y": -12.0, "z": 45.0, "heading": 45.0},
    "barometric_pressure": 1013.25,
    "device": {"battery_level": 0.85, "signal_strength": -65, "device_orientation": "portrait",
               "screen_on": True, "charging": False},
}

CASES = {
    1: dict(speed=35.0, ax=6.0, ay=5.5, az=1.0, g=8.2),   # high g
    2: dict(speed=2.0, ax=1.5, ay=1.2, az=1.0, g=2.1),    # sudden stop
    3: dict(speed=30.0, ax=0.2, ay=-0.1, az=0.98, g=1.0),  # normal driving
    4: dict(speed=3.0, ax=0.5, ay=0.3, az=0.9, g=1.1),    # slow, low g
}

# Fixed values worked out from the rules for these four messages.
EXPECTED = {
    1: dict(crash=True, total=0.835944, lateral=0.829705, vertical=0.898063,
            type="HIGH_G_FORCE", risk=73.8, decel=71.75),
    2: dict(crash=True, total=0.220758, lateral=0.195814, vertical=0.898063,
            type="SUDDEN_STOP", risk=18.900000000000002, decel=1.05),
    3: dict(crash=False, total=0.102465, lateral=0.022794, vertical=0.900102,
            type="UNKNOWN", risk=9.0, decel=0.0),
    4: dict(crash=False, total=0.109315, lateral=0.059439, vertical=0.908257,
            type="UNKNOWN", risk=9.9, decel=0.0),
}


@pytest.fixture(scope="module")
def rows(spark):
    docs = [message(i, speed=kw["speed"], g=kw["g"],
                    sensors=SENSORS | {"accelerometer": {a: kw[f"a{a}"] for a in "xyz"}})
            for i, kw in CASES.items()]
    msg, bad = analysed(spark, docs, "message")
    assert bad.count() == 0
    batch, _ = analysed(spark, docs, "batch")
    return by_id(msg), by_id(batch), msg


@pytest.mark.parametrize("mid", sorted(CASES))
def test_message_profile(rows, mid):
    msg, _, _ = rows
    r, e = msg[mid], EXPECTED[mid]
    assert r["is_crash"] is e["crash"]
    assert round(r["total_g_force"], 6) == e["total"]
    assert round(r["lateral_g_force"], 6) == e["lateral"]
    assert round(r["vertical_g_force"], 6) == e["vertical"]
    assert r["crash_type"] == e["type"]
    assert r["risk_score"] == e["risk"]


@pytest.mark.parametrize("mid", sorted(CASES))
def test_shared_derivations(rows, mid):
    r = rows[0][mid]
    # battery 0.85 counts as critically low: threshold 4.0 * 1.1
    assert r["g_threshold"] == 4.4
    assert r["gps_quality"] == "EXCELLENT"
    assert r["cardinal_direction"] == "NE"
    assert r["motion_type"] == "STABLE"
    assert r["device_health_status"] == "CRITICAL_BATTERY"
    assert r["battery_percentage"] == 0
    assert r["signal_quality"] == "FAIR"


@pytest.mark.parametrize("mid", sorted(CASES))
def test_batch_profile_never_crashes(rows, mid):
    assert rows[1][mid]["is_crash"] is False


def test_reports(rows):
    _, _, msg = rows
    reports, unbuildable = crash_reports(msg, "message")
    got = by_id(reports)
    assert sorted(got) == [1, 2]
    assert unbuildable.count() == 0
    for mid in (1, 2):
        rep = got[mid]
        assert rep["report_id"] == "CRASH-TESTPOLICY-1721817000000"
        assert rep["severity_level"] == "CRITICAL"
        assert rep["emergency_recommended"] is True
        assert rep["impact_details"]["deceleration_rate"] == EXPECTED[mid]["decel"]
        assert rep["crash_timestamp"] == "2024-07-24T10:30:00Z"
        # message profile passes the reported g as "total"
        assert rep["total_g_force"] == CASES[mid]["g"]
        assert rep["location"]["accuracy_meters"] is None
