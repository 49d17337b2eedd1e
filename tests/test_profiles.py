"""Where the message and batch rule profiles disagree."""

import pytest
from helpers import analysed, by_id, message

HEALTHY = {"sensors__device__battery_level": 80.0}


def _case(mid, **kw):
    base = dict(HEALTHY)
    base.update(kw)
    return message(mid, **base)


CASES = [
    # id, message, expected (msg crash, msg type, batch crash, batch type)
    (1, _case(1, sensors__gyroscope={"x": 0.0, "y": 3.0, "z": 0.0}),
     (False, "UNKNOWN", True, "ROLLOVER")),
    (2, _case(2, sensors__gyroscope={"x": 0.0, "y": 0.0, "z": 2.0}),
     (False, "UNKNOWN", False, "SPINNING")),
    (3, _case(3, sensors__gyroscope={"x": 0.0, "y": 0.0, "z": 2.5}),
     (True, "SPINNING", False, "SPINNING")),
    (4, _case(4, g=5.0), (True, "HIGH_G_FORCE", False, "UNKNOWN")),
    # derived total g 4.1 (lateral 2.9, vertical 1.9), reported g 1
    (5, _case(5, ax=28.449, az=28.449, g=1.0), (False, "UNKNOWN", True, "HIGH_G_FORCE")),
    (6, _case(6, g=4.2, sensors__device__battery_level=15.0),
     (False, "HIGH_G_FORCE", False, "UNKNOWN")),
    (7, _case(7, g=3.7, sensors__barometric_pressure=970.0), (True, "UNKNOWN", False, "UNKNOWN")),
    (8, _case(8, g=3.96, sensors__barometric_pressure=970.0,
              sensors__device__battery_level=15.0), (False, "UNKNOWN", False, "UNKNOWN")),
]


@pytest.fixture(scope="module")
def results(spark):
    docs = [m for _, m, _ in CASES]
    return by_id(analysed(spark, docs, "message")[0]), by_id(analysed(spark, docs, "batch")[0])


@pytest.mark.parametrize("mid,doc,expected", CASES, ids=[str(c[0]) for c in CASES])
def test_disagreement(results, mid, doc, expected):
    msg, batch = results
    got = (msg[mid]["is_crash"], msg[mid]["crash_type"],
           batch[mid]["is_crash"], batch[mid]["crash_type"])
    assert got == expected


def test_adaptive_threshold_rounding(results):
    msg, _ = results
    assert msg[8]["g_threshold"] == 4.0 * 0.9 * 1.1 == 3.9600000000000004
    assert msg[7]["g_threshold"] == 3.6


def test_classify_and_risk_category(spark):
    from helpers import frame

    from impactlens.operators.detect import classify, risk_category
    from impactlens.operators.enrich import enrich
    from impactlens.sources.ingest import canonicalise, prepare

    docs = [m for _, m, _ in CASES]
    good, _ = prepare(canonicalise(frame(spark, docs)))
    rows = by_id(risk_category(classify(enrich(good), "batch")))
    assert rows[1]["crash_type"] == "ROLLOVER" and rows[1]["risk_category"] == "ROLLOVER_RISK"
    assert rows[2]["crash_type"] == "SPINNING" and rows[2]["risk_category"] == "SPINNING_RISK"
    assert rows[4]["risk_category"] == "NORMAL_RISK"
