"""Message builders for hand-written JSON cases."""

import copy
import json

BASE_SENSORS = {
    "gps": {"lat": 52.5163, "lon": 13.3777, "altitude": 34.0, "speed": 13.5, "bearing": 51.0,
            "accuracy": 4.25, "satellite_count": 9, "fix_time": "2024-07-24T10:29:59Z"},
    "accelerometer": {"x": 0.0, "y": 0.0, "z": 9.81},
    "gyroscope": {"x": 0.0, "y": 0.0, "z": 0.0},
    "magnetometer": {"x": 19.5, "y": 21.0, "z": 43.5, "heading": 50.0},
    "barometric_pressure": 1009.5,
    "device": {"battery_level": 0.7, "signal_strength": -66, "device_orientation": "portrait",
               "screen_on": False, "charging": False},
}


def message(mid, speed=30.0, ax=0.0, ay=0.0, az=9.81, g=1.0, **over):
    sensors = copy.deepcopy(BASE_SENSORS)
    sensors["accelerometer"] = {"x": ax, "y": ay, "z": az}
    m = {"message_id": mid, "policy_id": "TEST-POLICY", "vin": "VIN123456789",
         "timestamp": "2024-07-24T10:30:00Z", "speed_mph": speed, "current_street": "Harbour Rd",
         "g_force": g, "sensors": sensors}
    for path, value in over.items():
        node = m
        keys = path.split("__")
        for k in keys[:-1]:
            node = node[k]
        if value is DELETE:
            node.pop(keys[-1], None)
        else:
            node[keys[-1]] = value
    return m


DELETE = object()


def frame(spark, docs):
    """JSON documents (dicts or raw strings) -> DataFrame(value)."""
    rows = [(d if isinstance(d, str) else json.dumps(d),) for d in docs]
    return spark.createDataFrame(rows, "value string")


def analysed(spark, docs, profile="message"):
    from impactlens.operators.detect import analyse
    from impactlens.sources.ingest import parse_telemetry, prepare

    good, bad = prepare(parse_telemetry(frame(spark, docs)))
    return analyse(good, profile), bad


def by_id(df, key="message_id"):
    return {r[key]: r for r in df.collect()}
