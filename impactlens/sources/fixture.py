"""Telemetry derived from the ``events`` table.

The test data has no telemetry, so one message is derived per ``events``
row, deterministically, as a narrow projection (no shuffle, only
``event_id, ts, user_id`` are read from the scan). ``p = event_id % 50``
selects a scenario (crash of each type under each rule profile, adaptive
thresholds, null structs and fields, the three timestamp encodings); see
FIXTURES.md section 4 for the table this module implements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Street names cycled by event_id % 4.
STREETS = ("Harbour Rd", "Mill Lane", "Oak Ave", "5th Ave")


def _case(default: str, overrides: dict) -> str:
    """SQL ``CASE`` on ``p``: ``default`` unless ``p`` is an override key."""
    arms = []
    for keys, val in overrides.items():
        keys = keys if isinstance(keys, tuple) else (keys,)
        arms.append(f"WHEN p IN ({', '.join(map(str, keys))}) THEN {val}")
    return f"CASE {' '.join(arms)} ELSE {default} END" if arms else default


def _wave(mult: int, div: str) -> str:
    return f"((i * {mult}) % 101 - 50) / {div}"


_SPEED = _case("5.1D + ((i * 7) % 700) / 10.0D", {(5, 21, 29): "3.0D", 35: "5.0D"})

# Spark SQL expressions over i = event_id, p = i % 50, ts (UTC timestamp);
# literals carry the D suffix so every operation is double arithmetic.
_FLAT = {
    "policy_id": "CASE WHEN p IN (20, 32) THEN NULL ELSE concat('POL-', CAST(user_id AS STRING)) END",
    "vin": "concat('VIN', lpad(CAST(user_id AS STRING), 14, '0'))",
    "timestamp": """CASE WHEN p = 41 THEN 'not-a-time' WHEN p = 43 THEN '2024-01-05'
        WHEN p = 44 THEN concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '+02:00')
        WHEN i % 3 = 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        WHEN i % 3 = 1 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ELSE concat(CAST(floor(us / 1000000) AS STRING), '.',
                    lpad(CAST(us % 1000000 AS STRING), 6, '0'), '000') END""",
    "speed_mph": _SPEED,
    "current_street": "element_at(array({}), CAST(i % 4 + 1 AS INT))".format(
        ", ".join(f"'{s}'" for s in STREETS)),
    "g_force": _case("0.9D + (i % 20) / 100.0D", {
        5: "2.5D", (6, 32, 33): "5.0D", (7, 19, 25, 26, 27): "4.2D", 8: "3.7D", 9: "4.0D",
        12: "9.0D", 21: "1.9D", 24: "6.5D", 30: "3.96D", 31: "3.97D", 35: "2.0D"}),
    "ax": _case(_wave(13, "50.0D"), {(1, 13): "32.0D", 22: "0.0D", 28: "29.0D", 29: "18.0D"}),
    "ay": _case(_wave(17, "50.0D"), {22: "29.43D", 28: "0.0D"}),
    "az": _case("9.81D", {2: "32.0D", 23: "49.05D", 28: "29.0D"}),
    "gx": _case(_wave(19, "200.0D"), {11: "0.0D", 14: "2.2D"}),
    "gy": _case(_wave(23, "200.0D"), {(3, 13): "3.5D", 11: "3.0D"}),
    "gz": _case(_wave(29, "200.0D"), {4: "2.5D", 10: "-2.0D", 11: "0.0D"}),
    "mx": "CAST((i * 41) % 101 - 50 AS DOUBLE)",
    "my": "CAST((i * 43) % 101 - 50 AS DOUBLE)",
    "mz": _case("45.0D", {39: "200.0D"}),
    "heading_in": _case("CASE WHEN i % 5 = 0 THEN CAST((i * 9) % 360 AS DOUBLE) END",
                        {40: "337.5D", 45: "22.5D"}),
    "pressure": _case("1000.0D + (i % 30)", {(8, 30, 31): "970.0D", 15: "890.0D",
                                             16: "1060.0D", 17: "CAST(NULL AS DOUBLE)"}),
    "battery": _case("50.0D + (i % 50)", {(7, 30, 31): "15.0D", 18: "5.0D"}),
    "signal": "CAST(" + _case("-40 - i % 40", {19: "-95"}) + " AS INT)",
    "accuracy": _case("1.0D + (i % 40) / 10.0D", {25: "12.0D", 26: "CAST(NULL AS DOUBLE)"}),
    "satellites": "CAST(" + _case("4 + i % 8", {27: "3"}) + " AS INT)",
    "lat": "33.7D + ((i * 31) % 1000) / 10000.0D",
    "lon": "-84.4D + ((i * 37) % 1000) / 10000.0D",
    "altitude": _case("300.0D + (i % 100)", {36: "1500.0D"}),
    "gps_speed": _case(f"({_SPEED}) / 2.237D", {37: f"({_SPEED}) / 2.237D + 10.0D",
                                                38: "CAST(NULL AS DOUBLE)"}),
    "bearing": "CAST((i * 11) % 360 AS DOUBLE)",
    "orientation": "CASE i % 3 WHEN 0 THEN 'portrait' WHEN 1 THEN 'LANDSCAPE' END",
    "screen_on": "CASE WHEN p = 46 THEN CAST(NULL AS BOOLEAN) ELSE i % 2 = 0 END",
    "charging": "CASE WHEN p = 47 THEN CAST(NULL AS BOOLEAN) ELSE i % 4 = 0 END",
    "fix_time": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
}

_NESTED = [
    "i AS message_id", "policy_id", "vin", "timestamp", "speed_mph", "current_street", "g_force",
    """named_struct(
        'gps', CASE WHEN p = 33 THEN NULL ELSE named_struct(
            'lat', lat, 'lon', lon, 'altitude', altitude, 'speed', gps_speed, 'bearing', bearing,
            'accuracy', accuracy, 'satellite_count', satellites, 'fix_time', fix_time) END,
        'accelerometer', named_struct('x', ax, 'y', ay, 'z', az),
        'gyroscope', named_struct('x', gx, 'y', gy, 'z', gz),
        'magnetometer', named_struct('x', mx, 'y', my, 'z', mz, 'heading', heading_in),
        'barometric_pressure', pressure,
        'device', named_struct('battery_level', battery, 'signal_strength', signal,
                               'device_orientation', orientation, 'screen_on', screen_on,
                               'charging', charging)) AS sensors""",
]


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, ...) -> canonical telemetry rows.

    Two SQL projections: the flat scenario values, then the nested message.
    The struct is built with the canonical leaf types directly (no cast of
    the whole struct, which would hide its fields from Catalyst's struct
    simplification)."""
    base = events.selectExpr("event_id AS i", "event_id % 50 AS p", "CAST(ts AS TIMESTAMP) AS ts",
                             "unix_micros(CAST(ts AS TIMESTAMP)) AS us", "user_id")
    flat = base.selectExpr("i", "p", *[f"{expr} AS {name}" for name, expr in _FLAT.items()])
    return flat.selectExpr(*_NESTED)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return ev.select("event_id", "ts", "user_id")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_events(read_events(spark, sf_dir))


# --- JSON text in the three documented layouts -------------------------------

def _canonical_json_struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def _readme_json_struct() -> Column:
    """Code layout except gps latitude/longitude/speed_ms/gps_fix_time and
    device orientation."""
    g, d = "sensors.gps", "sensors.device"
    gps = F.when(F.col(g).isNotNull(), F.struct(
        F.col(f"{g}.lat").alias("latitude"), F.col(f"{g}.lon").alias("longitude"),
        F.col(f"{g}.altitude").alias("altitude"), F.col(f"{g}.speed").alias("speed_ms"),
        F.col(f"{g}.bearing").alias("bearing"), F.col(f"{g}.accuracy").alias("accuracy"),
        F.col(f"{g}.satellite_count").alias("satellite_count"),
        F.col(f"{g}.fix_time").alias("gps_fix_time")))
    dev = F.when(F.col(d).isNotNull(), F.struct(
        F.col(f"{d}.battery_level").alias("battery_level"),
        F.col(f"{d}.signal_strength").alias("signal_strength"),
        F.col(f"{d}.device_orientation").alias("orientation"),
        F.col(f"{d}.screen_on").alias("screen_on"), F.col(f"{d}.charging").alias("charging")))
    sensors = F.struct(gps.alias("gps"), F.col("sensors.accelerometer").alias("accelerometer"),
                       F.col("sensors.gyroscope").alias("gyroscope"),
                       F.col("sensors.magnetometer").alias("magnetometer"),
                       F.col("sensors.barometric_pressure").alias("barometric_pressure"),
                       dev.alias("device"))
    return F.struct("message_id", "policy_id", "vin", "timestamp", "speed_mph", "current_street",
                    "g_force", sensors.alias("sensors"))


def _sample_json_struct() -> Column:
    """camelCase top level, barometric.pressure, deviceHealth, and only the
    fields that layout documents."""
    g, d, m = "sensors.gps", "sensors.device", "sensors.magnetometer"
    gps = F.when(F.col(g).isNotNull(), F.struct(
        F.col(f"{g}.lat").alias("latitude"), F.col(f"{g}.lon").alias("longitude"),
        F.col(f"{g}.accuracy").alias("accuracy"), F.col(f"{g}.speed").alias("speed")))
    mag = F.when(F.col(m).isNotNull(), F.struct(*[F.col(f"{m}.{a}").alias(a) for a in "xyz"]))
    baro = F.when(F.col("sensors.barometric_pressure").isNotNull(),
                  F.struct(F.col("sensors.barometric_pressure").alias("pressure")))
    dev = F.when(F.col(d).isNotNull(), F.struct(
        F.col(f"{d}.battery_level").alias("batteryLevel"),
        F.col(f"{d}.signal_strength").alias("signalStrength")))
    sensors = F.struct(F.col("sensors.accelerometer").alias("accelerometer"),
                       F.col("sensors.gyroscope").alias("gyroscope"), mag.alias("magnetometer"),
                       baro.alias("barometric"), gps.alias("gps"), dev.alias("deviceHealth"))
    return F.struct(F.col("message_id"), F.col("policy_id").alias("policyId"), F.col("vin"),
                    F.col("timestamp"), F.col("speed_mph").alias("speedMph"),
                    F.col("current_street").alias("currentStreet"),
                    F.col("g_force").alias("gForce"), sensors.alias("sensors"))


LAYOUTS = ("code", "readme", "sample")


def json_text(df: DataFrame, layout: str = "code") -> Column:
    """JSON text of each canonical row in one of the documented layouts."""
    if layout == "code":
        s = _canonical_json_struct(df)
    elif layout == "readme":
        s = _readme_json_struct()
    elif layout == "sample":
        s = _sample_json_struct()
    else:
        raise ValueError(f"unknown layout {layout!r}; expected one of {LAYOUTS}")
    return F.to_json(s)


def as_json(df: DataFrame, layout: str = "code") -> DataFrame:
    """Canonical telemetry -> one JSON message per row (``value``)."""
    return df.select(json_text(df, layout).alias("value"))


def as_json_layouts(df: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """Every row once per layout, in one pass: (``layout``, ``value``)."""
    msgs = F.array(*[F.struct(F.lit(name).alias("layout"), json_text(df, name).alias("value"))
                     for name in layouts])
    return df.select(F.inline(msgs))


#: Messages are damaged by ``message_id % DAMAGE``; most remainders stay whole.
DAMAGE = 23


def damaged(df: DataFrame) -> DataFrame:
    """JSON messages (``message_id`` beside ``value``) as faulty devices send
    them: cut off (1), an empty string for a number (2), an integer for a
    boolean (3), without sensors (4), accelerometer (5), gyroscope (6),
    magnetometer (7), a word for a number (8), without device (9), vin (10)
    or policy (11)."""
    k, v = F.pmod(F.col("message_id"), F.lit(DAMAGE)), F.col("value")
    gone = lambda name: F.replace(v, F.lit(f'"{name}":'), F.lit(f'"no_{name}":'))
    g_force = lambda text: F.regexp_replace(v, '"g_force":[^,]+', f'"g_force":"{text}"')
    out = F.when(k == 1, F.substring(v, 1, 1)).when(k == 2, g_force("")).when(k == 3, F.regexp_replace(
        v, '"screen_on":(true|false)', '"screen_on":1')).when(k == 8, g_force("fast"))
    for rest, name in ((4, "sensors"), (5, "accelerometer"), (6, "gyroscope"), (7, "magnetometer"),
                       (9, "device"), (10, "vin"), (11, "policy_id")):
        out = out.when(k == rest, gone(name))
    return df.withColumn("value", out.otherwise(v))


def as_damaged_json(df: DataFrame) -> DataFrame:
    return damaged(df.select("message_id", json_text(df, "code").alias("value"))).select("value")
