"""JSON, time and null handling (FIXTURES section 3)."""

import json

import pytest
from helpers import DELETE, analysed, by_id, frame, message
from pyspark.sql import functions as F

from impactlens.operators.report import crash_reports
from impactlens.sources.ingest import parse_telemetry, prepare, with_event_time


def _millis(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "timestamp string")
    out = with_event_time(df).select("timestamp", F.unix_millis("event_time").alias("ms"))
    return {r["timestamp"]: r["ms"] for r in out.collect()}


def test_timestamps(spark):
    got = _millis(spark, [
        "2025-07-24T17:19:14.123456Z", "1753411278.026699000", "2024-07-24T15:30:45.123Z",
        "2024-07-24T10:30:00Z", "2024-07-24T10:30:00+02:00", "2024-07-24T10:30Z",
        "2024-07-24t10:30:00z", "junk", "2024-07-24", None])
    assert got["2025-07-24T17:19:14.123456Z"] == 1753377554123
    assert got["1753411278.026699000"] == 1753411278026
    assert got["2024-07-24T15:30:45.123Z"] == 1721835045123
    assert got["2024-07-24T10:30:00Z"] == 1721817000000
    assert got["2024-07-24T10:30:00+02:00"] == 1721817000000 - 2 * 3600 * 1000
    assert got["2024-07-24T10:30Z"] == 1721817000000
    assert got["2024-07-24t10:30:00z"] == 1721817000000
    assert got["junk"] is None and got["2024-07-24"] is None and got[None] is None


def _reasons(spark, docs):
    good, bad = prepare(parse_telemetry(frame(spark, docs)))
    return {r["message_id"]: r["reason"] for r in bad.collect()}, good


def test_quarantine_reasons(spark):
    docs = [
        message(1),
        message(2, sensors=None),
        message(3, sensors__accelerometer=DELETE),
        message(4, sensors__gyroscope=DELETE),
        message(5, timestamp="junk"),
        message(6, timestamp="2024-07-24"),
        message(7, timestamp=None),
        message(8, g_force="abc"),
    ]
    reasons, good = _reasons(spark, docs)
    assert reasons == {2: "missing_sensors", 3: "missing_accelerometer", 4: "missing_gyroscope",
                       5: "bad_timestamp", 6: "bad_timestamp", 7: "bad_timestamp",
                       8: "bad_value"}
    assert [r["message_id"] for r in good.collect()] == [1]


def test_malformed_json(spark):
    good, bad = prepare(parse_telemetry(frame(spark, ["this is not json", '{"sensors": null}'])))
    assert good.count() == 0
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed_json", "missing_sensors"]


def test_coercions_and_defaults(spark):
    docs = [message(1, g_force="4.5"), message(2, sensors__device__signal_strength=-65.0),
            message(3, speed_mph=DELETE, g_force=DELETE),
            message(4, g_force=None, sensors__device__screen_on="true")]
    rows = by_id(with_event_time(parse_telemetry(frame(spark, docs))))
    assert rows[1]["g_force"] == 4.5
    assert rows[2]["sensors"]["device"]["signal_strength"] == -65
    assert rows[3]["speed_mph"] == 0.0 and rows[3]["g_force"] == 0.0
    assert rows[4]["g_force"] == 0.0
    assert rows[4]["sensors"]["device"]["screen_on"] is True


def test_missing_optional_structs(spark):
    docs = [message(1, sensors__device=DELETE, sensors__barometric_pressure=DELETE),
            message(2, sensors__gps=DELETE)]
    rows = by_id(analysed(spark, docs)[0])
    r1 = rows[1]
    assert not r1["device_issues"] and not r1["environmental_risk"]
    assert r1["device_health_status"] is None and r1["estimated_altitude_m"] == 0.0
    assert r1["g_threshold"] == 4.0
    assert rows[2]["gps_reliable"] is True and rows[2]["gps_quality"] is None


def test_crash_without_policy_is_kept(spark):
    docs = [message(1, g=9.0, policy_id=None), message(2, g=9.0, sensors__gps=DELETE),
            message(3, g=9.0, sensors__magnetometer=DELETE), message(4, g=9.0)]
    df, _ = analysed(spark, docs)
    assert all(r["is_crash"] for r in df.collect())
    reports, unbuildable = crash_reports(df, "message")
    assert [r["message_id"] for r in reports.collect()] == [4]
    assert {r["message_id"]: r["reason"] for r in unbuildable.collect()} == {
        1: "report_missing_policy_id", 2: "report_missing_gps",
        3: "report_missing_magnetometer"}


NESTED_MESSAGE = {
    "policy_id": "POL-555", "vin": "TESTVIN0000000001",
    "timestamp": "2023-03-04T05:06:07.250000Z", "speed_mph": 21.25,
    "current_street": "Harbour Rd", "g_force": 1.5,
    "sensors": {
        "gps": {"latitude": 51.5, "longitude": 7.25, "altitude": 86.0, "speed_ms": 9.5,
                "bearing": 180.0, "accuracy": 2.5, "satellite_count": 11,
                "gps_fix_time": "2023-03-04T05:06:07Z"},
        "accelerometer": {"x": 0.5, "y": -0.25, "z": 9.75},
        "gyroscope": {"x": 0.125, "y": -0.5, "z": 0.25},
        "magnetometer": {"x": 12.0, "y": -8.0, "z": 31.0, "heading": 200.0},
        "barometric_pressure": 1001.5,
        "device": {"battery_level": 64.0, "signal_strength": -71, "orientation": "landscape",
                   "screen_on": False, "charging": True}}}

CAMEL_MESSAGE = {
    "policyId": "POL-777", "vin": "TESTVIN0000000002",
    "timestamp": "2023-03-05T08:09:10.500Z", "speedMph": 48.75, "currentStreet": "Oak Ave",
    "gForce": 0.75,
    "sensors": {
        "accelerometer": {"x": 0.25, "y": -0.5, "z": 9.5},
        "gyroscope": {"x": 0.5, "y": -0.125, "z": 0.75},
        "magnetometer": {"x": 14.0, "y": -9.0, "z": 28.0},
        "barometric": {"pressure": 998.25, "altitude": 75.0},
        "gps": {"latitude": 48.25, "longitude": 11.5, "accuracy": 4.5, "speed": 21.5},
        "deviceHealth": {"batteryLevel": 41, "signalStrength": -58, "temperature": 19.5}}}


def test_documented_layouts(spark):
    df, bad = analysed(spark, [json.dumps(NESTED_MESSAGE), json.dumps(CAMEL_MESSAGE)])
    assert bad.count() == 0
    rows = {r["policy_id"]: r for r in df.collect()}
    nested = rows["POL-555"]
    assert nested["is_crash"] is False and nested["g_force"] == 1.5
    assert nested["sensors"]["gps"]["lat"] == 51.5
    assert nested["sensors"]["gps"]["speed"] == 9.5
    assert nested["sensors"]["device"]["device_orientation"] == "landscape"
    camel = rows["POL-777"]
    assert camel["speed_mph"] == 48.75 and camel["g_force"] == 0.75
    assert camel["sensors"]["barometric_pressure"] == 998.25
    assert camel["sensors"]["device"]["battery_level"] == 41.0
    assert camel["battery_percentage"] == 41
    assert camel["sensors"]["gps"]["lon"] == 11.5


def test_lenient_values(spark):
    """An empty string is null; an integer is a boolean."""
    docs = [message(1, g_force="", sensors__gps__altitude=""), message(2, sensors__device__screen_on=1),
            message(3, sensors__device__screen_on=0), message(4, sensors__device__charging="perhaps")]
    good, bad = prepare(parse_telemetry(frame(spark, docs)))
    rows = by_id(good)
    assert rows[1]["g_force"] == 0.0 and rows[1]["sensors"]["gps"]["altitude"] is None
    assert rows[2]["sensors"]["device"]["screen_on"] is True
    assert rows[3]["sensors"]["device"]["screen_on"] is False
    assert [(r["message_id"], r["reason"]) for r in bad.collect()] == [(4, "bad_value")]


def test_file_source(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text("\n".join(json.dumps(message(i)) for i in range(5)) + "\nnope\n")
    from impactlens.sources.ingest import read_telemetry

    good, bad = prepare(read_telemetry(spark, str(path)))
    assert good.count() == 5
    assert [r["reason"] for r in bad.collect()] == ["malformed_json"]


VALUES = ["5", "5.5", "-0.0", '"7"', '" 8 "', '"x"', '""', "true", '"TRUE"', '"0"', "0", "null", "[1]", '{"a":1}',
          '"NaN"', '"INF"', "99999999999", "12345678901234567890", '"1d"', "8.7", "8.0", '"2024-07-24T10:30:00Z"', "NaN"]
LEAVES = ["message_id", "policy_id", "policyId", "vin", "timestamp", "speed_mph", "speedMph", "currentStreet", "g_force", "gForce",
          "sensors", "sensors.gps", "sensors.gps.lat", "sensors.gps.latitude", "sensors.gps.speed_ms", "sensors.gps.satellite_count",
          "sensors.gps.gps_fix_time", "sensors.accelerometer", "sensors.accelerometer.x", "sensors.magnetometer.heading",
          "sensors.barometric_pressure", "sensors.barometric", "sensors.device", "sensors.deviceHealth", "sensors.device.screen_on",
          "sensors.device.charging", "sensors.device.signal_strength", "sensors.device.batteryLevel", "other", "sensors.other"]


def _with(path, text):
    """A message whose ``path`` holds the JSON ``text``."""
    m = message(1)
    node, keys = m, path.split(".")
    for k in keys[:-1]:
        node = node[k]
    node[keys[-1]] = "@@"
    return json.dumps(m).replace('"@@"', text)


def test_typed_reading_equals_coercion(spark, monkeypatch):
    """Every kind of value in every place, read with typed leaves first and
    read as text only, gives the same columns and the same reasons."""
    from impactlens.sources import ingest

    docs = [_with(path, v) for path in LEAVES for v in VALUES]
    docs += [json.dumps(message(1)), "", " ", "{", "[]", "{}", "[1]", json.dumps([message(1)]), json.dumps(message(1)) + "x",
             json.dumps(message(1))[:-1], "null", '"a"', '{"g_force": 1, "g_force": "2"}', '{"vin": "\\u0000é", "sensors": {}}']
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, value string").union(
        spark.createDataFrame([(-1, None)], "i int, value string"))

    def read():
        df = with_event_time(parse_telemetry(rows, carry=("i",)))
        return {r.i: str(r) for r in df.withColumn("reason", ingest.quarantine_reason(df)).collect()}

    got = read()
    monkeypatch.setattr(ingest, "_canonical", ingest._coerced)
    want = read()
    assert len(got) == len(docs) + 1
    assert {docs[i]: (got[i], want[i]) for i in got if got[i] != want[i]} == {}


def test_numbers_beyond_double_are_infinite(spark):
    docs = ['{"g_force": 1e400}', '{"g_force": "1e400"}', '{"g_force": -1e400}']
    got = [(r.g_force, r._type_error) for r in parse_telemetry(frame(spark, docs)).collect()]
    assert got == [(float("inf"), False), (float("inf"), False), (float("-inf"), False)]


def test_only_asked_fields_are_parsed(spark):
    docs = [message(1, g_force="2.5", vin="A"), message(2, vin=None, speed_mph="junk")]
    df = parse_telemetry(frame(spark, docs), keep_value=False, fields=("vin", "g_force"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StructField(vin" in plan and "StructField(gForce" in plan
    assert not any(f"StructField({name}" in plan for name in ("sensors", "speed_mph", "policy_id", "timestamp"))
    assert [(r.vin, r.g_force, r._type_error) for r in df.orderBy("g_force").collect()] == [(None, 1.0, False), ("A", 2.5, False)]
    part = parse_telemetry(frame(spark, docs), fields=("message_id", "sensors.gps", "sensors.device"))
    assert part.schema["sensors"].dataType.names == ["gps", "device"]
    assert part.filter("sensors.gps.lat IS NOT NULL").count() == 2
    with pytest.raises(ValueError, match="unknown fields"):
        parse_telemetry(frame(spark, docs), fields=("speed",))
