"""Telemetry and crash-report schemas.

``TELEMETRY`` is the canonical typed message. ``RAW_TYPED`` is the union of the
documented JSON layouts as well-formed messages have it. ``RAW_TELEMETRY`` is
the same with every scalar leaf read as a string, so that quoted numbers,
floats for ints and numbers for strings are coerced afterwards with
``try_cast`` (the JSON reader does not coerce on its own).
"""

from __future__ import annotations

from pyspark.sql import types as T

D = T.DoubleType()
I = T.IntegerType()
S = T.StringType()
B = T.BooleanType()
L = T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


GPS = _struct(("lat", D), ("lon", D), ("altitude", D), ("speed", D), ("bearing", D),
              ("accuracy", D), ("satellite_count", I), ("fix_time", S))
XYZ = _struct(("x", D), ("y", D), ("z", D))
MAGNETOMETER = _struct(("x", D), ("y", D), ("z", D), ("heading", D))
DEVICE = _struct(("battery_level", D), ("signal_strength", I), ("device_orientation", S),
                 ("screen_on", B), ("charging", B))
SENSORS = _struct(("gps", GPS), ("accelerometer", XYZ), ("gyroscope", XYZ),
                  ("magnetometer", MAGNETOMETER), ("barometric_pressure", D), ("device", DEVICE))

# message_id is optional: carried when the producer sends one (the events
# fixture always does); it is only used as a stable tie-break key.
TELEMETRY = _struct(("message_id", L), ("policy_id", S), ("vin", S), ("timestamp", S),
                    ("speed_mph", D), ("current_street", S), ("g_force", D), ("sensors", SENSORS))

# --- raw superset schema: union of the three documented layouts ------------
RAW_GPS = _struct(("lat", D), ("lon", D), ("latitude", D), ("longitude", D), ("altitude", D),
                  ("speed", D), ("speed_ms", D), ("bearing", D), ("accuracy", D),
                  ("satellite_count", I), ("fix_time", S), ("gps_fix_time", S))
RAW_DEVICE = _struct(("battery_level", D), ("batteryLevel", D), ("signal_strength", I),
                     ("signalStrength", I), ("device_orientation", S), ("orientation", S),
                     ("screen_on", B), ("charging", B))
RAW_SENSORS = _struct(("gps", RAW_GPS), ("accelerometer", XYZ), ("gyroscope", XYZ),
                      ("magnetometer", MAGNETOMETER), ("barometric_pressure", D),
                      ("barometric", _struct(("pressure", D))), ("device", RAW_DEVICE),
                      ("deviceHealth", RAW_DEVICE))
RAW_TYPED = _struct(("message_id", L), ("policy_id", S), ("policyId", S), ("vin", S),
                    ("timestamp", S), ("speed_mph", D), ("speedMph", D),
                    ("current_street", S), ("currentStreet", S), ("g_force", D),
                    ("gForce", D), ("sensors", RAW_SENSORS), ("_corrupt_record", S))


def as_text(schema: T.StructType) -> T.StructType:
    """The same fields, every scalar a string."""
    return T.StructType([T.StructField(f.name, as_text(f.dataType) if isinstance(f.dataType, T.StructType) else S, True)
                         for f in schema.fields])


RAW_TELEMETRY = as_text(RAW_TYPED)

# --- crash report (nested, JSON property names) ----------------------------
ACCEL_VECTOR = _struct(("x", D), ("y", D), ("z", D), ("magnitude", D))
CRASH_REPORT = _struct(
    ("report_id", S), ("policy_id", S), ("vin", S), ("crash_timestamp", S), ("crash_type", S),
    ("severity_level", S),
    ("impact_details", _struct(("total_g_force", D), ("lateral_g_force", D),
                               ("vertical_g_force", D), ("speed_at_impact", D),
                               ("acceleration_vector", ACCEL_VECTOR), ("deceleration_rate", D))),
    ("location", _struct(("latitude", D), ("longitude", D), ("current_street", S),
                         ("heading", D), ("accuracy_meters", D))),
    ("vehicle_data", _struct(("vin", S), ("speed_mph", D), ("heading", D))),
    ("sensor_analysis", _struct(
        ("accelerometer", _struct(("raw_values", ACCEL_VECTOR), ("total_magnitude", D),
                                  ("lateral_magnitude", D), ("vertical_magnitude", D))),
        ("gyroscope", _struct(("x", D), ("y", D), ("z", D), ("magnitude", D),
                              ("indicates_rollover", B), ("indicates_spinning", B))),
        ("magnetometer", _struct(("x", D), ("y", D), ("z", D), ("heading_degrees", D))),
        ("rollover_detected", B), ("spinning_detected", B))),
    ("emergency_recommended", B), ("risk_score", D), ("total_g_force", D),
    ("processed_timestamp", T.TimestampType()),
)
