"""Property check: both rule profiles against a plain-Python model of the
rule definitions, on random and boundary sensor values (exact thresholds,
adaptive-threshold products, NaN g-force, missing optional structs)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from impactlens.operators.detect import analyse
from impactlens.schema import TELEMETRY

G = 9.81


def _num(boundaries, lo, hi):
    return st.one_of(st.sampled_from(boundaries),
                     st.floats(min_value=lo, max_value=hi, allow_nan=False))


def _opt(s):
    return st.one_of(st.none(), s)


messages = st.fixed_dictionaries({
    "speed": _num([0.0, 4.999, 5.0, 5.001, 30.0], 0.0, 120.0),
    "g": st.one_of(_num([1.9, 2.0, 3.6, 3.96, 3.9600000000000004, 4.0, 4.4, 6.0, 8.0],
                        0.0, 12.0), st.just(float("nan"))),
    "ax": _num([0.0, 29.43, -29.43, 20.0], -40.0, 40.0),
    "ay": _num([0.0, 29.43, 1.0], -40.0, 40.0),
    "az": _num([9.81, 29.43, -9.81, 49.05], -40.0, 60.0),
    "gx": _num([0.0, 2.0, 2.2], -4.0, 4.0),
    "gy": _num([0.0, 3.0, -3.0, 1.7320508075688772], -4.0, 4.0),
    "gz": _num([0.0, 2.0, -2.0, 2.5], -4.0, 4.0),
    "pressure": _opt(_num([980.0, 979.99, 1050.0, 1050.01, 900.0, 899.9], 850.0, 1100.0)),
    "battery": _opt(_num([20.0, 19.99, 10.0, 9.99], 0.0, 100.0)),
    "signal": _opt(st.sampled_from([-50, -80, -81, -95])),
    "gps": st.booleans(),
    "accuracy": _opt(_num([5.0, 5.01], 0.0, 20.0)),
    "sats": _opt(st.sampled_from([3, 4, 8])),
    "device": st.booleans(),
})


def model(m):
    ax, ay, az, gx, gy, gz = (m[k] for k in ("ax", "ay", "az", "gx", "gy", "gz"))
    total = math.sqrt(ax * ax + ay * ay + az * az) / G
    lateral = math.sqrt(ax * ax + ay * ay) / G
    vertical = abs((az - G) / G)
    mag = math.sqrt(gx * gx + gy * gy + gz * gz)
    rollover = abs(gy) > 3.0 or mag > 3.0
    spinning = abs(gz) > 2.0
    p = m["pressure"]
    weather = p is not None and (p < 980.0 or p > 1050.0)
    high_alt = p is not None and p < 900.0
    bl = m["battery"] if m["device"] else None
    sig = m["signal"] if m["device"] else None
    low = bl is not None and bl < 20.0
    weak = sig is not None and sig < -80
    if m["gps"]:
        reliable = (m["accuracy"] is not None and m["accuracy"] <= 5.0) and (
            m["sats"] is not None and m["sats"] >= 4)
    else:
        reliable = True
    thr = 4.0
    if weather or high_alt:
        thr *= 0.9
    if low or weak or not reliable:
        thr *= 1.1
    g, speed = m["g"], m["speed"]
    msg_crash = (g >= thr or (speed <= 5.0 and g >= 2.0) or rollover or spinning
                 or lateral >= 3.0 or vertical >= 2.0)
    if rollover:
        msg_type = "ROLLOVER"
    elif spinning:
        msg_type = "SPINNING"
    elif lateral >= 3.0:
        msg_type = "SIDE_IMPACT"
    elif vertical >= 2.0:
        msg_type = "VERTICAL_IMPACT"
    elif speed <= 5.0 and g >= 2.0:
        msg_type = "SUDDEN_STOP"
    elif g >= 4.0:
        msg_type = "HIGH_G_FORCE"
    else:
        msg_type = "UNKNOWN"
    risk = g * 10
    for cond, f in ((rollover, 1.5), (spinning, 1.3), (lateral >= 3.0, 1.2),
                    (vertical >= 2.0, 1.1), (weather, 1.2), (high_alt, 1.1), (low, 0.9),
                    (weak, 0.9)):
        if cond:
            risk *= f
    risk = risk if math.isnan(risk) else min(risk, 100.0)
    batch_crash = (total >= 4.0 or (speed <= 5.0 and total >= 2.0) or mag >= 3.0
                   or lateral >= 3.0 or vertical >= 2.0)
    if mag >= 3.0:
        batch_type = "ROLLOVER"
    elif abs(gz) >= 2.0:
        batch_type = "SPINNING"
    elif lateral >= 3.0:
        batch_type = "SIDE_IMPACT"
    elif vertical >= 2.0:
        batch_type = "VERTICAL_IMPACT"
    elif speed <= 5.0 and total >= 2.0:
        batch_type = "SUDDEN_STOP"
    elif total >= 4.0:
        batch_type = "HIGH_G_FORCE"
    else:
        batch_type = "UNKNOWN"
    return msg_crash, msg_type, risk, batch_crash, batch_type


def _row(i, m):
    gps = None
    if m["gps"]:
        gps = (1.0, 2.0, None, None, None, m["accuracy"], m["sats"], None)
    device = (m["battery"], m["signal"], None, None, None) if m["device"] else None
    sensors = (gps, (m["ax"], m["ay"], m["az"]), (m["gx"], m["gy"], m["gz"]),
               (1.0, 1.0, 1.0, None), m["pressure"], device)
    return (i, "P", "V", "2024-01-01T00:00:00Z", m["speed"], "S", m["g"], sensors)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    return a == b


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(messages, min_size=40, max_size=40))
def test_rules_match_model(spark, batch):
    from impactlens.sources.ingest import with_event_time

    df = with_event_time(spark.createDataFrame([_row(i, m) for i, m in enumerate(batch)], TELEMETRY))
    msg = {r["message_id"]: r for r in analyse(df, "message").collect()}
    bat = {r["message_id"]: r for r in analyse(df, "batch").collect()}
    for i, m in enumerate(batch):
        mc, mt, risk, bc, bt = model(m)
        assert msg[i]["is_crash"] == mc, (m, "message crash")
        assert msg[i]["crash_type"] == mt, (m, "message type")
        assert _same(msg[i]["risk_score"], risk), (m, "risk", msg[i]["risk_score"], risk)
        assert bat[i]["is_crash"] == bc, (m, "batch crash")
        assert bat[i]["crash_type"] == bt, (m, "batch type")
