"""Oracle SQL (DuckDB dialect) for every query in the catalogue."""

from __future__ import annotations

from .oracle_base import ENRICHED

R6 = "round({0}, 6) AS {0}"


def _mean(c: str) -> str:
    """Order-independent mean: a sum of nine decimals, divided once."""
    return f"round(CAST(sum(CAST({c} AS DECIMAL(28, 9))) AS DOUBLE) / count({c}), 6)"


def _q(select: str) -> str:
    return ENRICHED + select


ORACLE: dict[str, str] = {
    "motion": _q("""SELECT message_id, total_g_force, lateral_g_force, vertical_g_force,
        gyro_magnitude, rollover, spinning, pitching, motion_type FROM g"""),
    "heading": _q(f"""SELECT message_id, {R6.format('heading')}, {R6.format('heading_computed')},
        has_heading, cardinal_direction, mag_magnitude FROM g"""),
    "gps_quality": _q("""SELECT message_id, gps_speed_mph, high_accuracy, good_satellites,
        gps_high_altitude, gps_quality, gps_reliable FROM g"""),
    "environment": _q(f"""SELECT message_id, weather_event, high_altitude,
        {R6.format('estimated_altitude_m')}, environmental_risk FROM g"""),
    "device_health": _q("""SELECT message_id, low_battery, critical_battery, weak_signal,
        device_issues, battery_percentage, device_health_status, signal_quality, portrait,
        landscape, screen_active, is_charging FROM g"""),
    "crashes_message": _q("""SELECT message_id, policy_id, msg_is_crash AS is_crash,
        msg_crash_type AS crash_type, g_threshold FROM g"""),
    "crashes_batch": _q("""SELECT message_id, policy_id, batch_is_crash AS is_crash,
        batch_crash_type AS crash_type FROM g"""),
    "risk_score": _q("SELECT message_id, risk_score FROM g"),
    "risk_category": _q("SELECT message_id, risk_category FROM g"),
    "risk_weight": _q("SELECT message_id, batch_crash_type AS crash_type, risk_weight FROM g"),
    "severity": _q("""SELECT message_id,
        CASE WHEN g_force >= 8.0e0 OR g_force >= 10.0e0 OR risk_score >= 0.9e0 THEN 'CRITICAL'
             WHEN g_force >= 6.0e0 OR g_force >= 7.0e0 OR risk_score >= 0.7e0 THEN 'HIGH'
             WHEN g_force >= 4.0e0 OR g_force >= 5.0e0 OR risk_score >= 0.5e0 THEN 'MEDIUM'
             ELSE 'LOW' END AS message_severity,
        risk_score >= 0.8e0 OR g_force >= 6.0e0 AS message_emergency,
        CASE WHEN g_force >= 8.0e0 OR total_g_force >= 10.0e0 OR risk_weight >= 0.9e0 THEN 'CRITICAL'
             WHEN g_force >= 6.0e0 OR total_g_force >= 7.0e0 OR risk_weight >= 0.7e0 THEN 'HIGH'
             WHEN g_force >= 4.0e0 OR total_g_force >= 5.0e0 OR risk_weight >= 0.5e0 THEN 'MEDIUM'
             ELSE 'LOW' END AS batch_severity,
        risk_weight >= 0.8e0 OR g_force >= 6.0e0 AS batch_emergency FROM g"""),
    "event_time": _q("""SELECT message_id, ts_text AS timestamp,
        strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time_utc,
        event_us IS NOT NULL AS parsed FROM s"""),
}


def _severity(g: str, total: str, risk: str) -> str:
    return f"""CASE WHEN {g} >= 8.0e0 OR {total} >= 10.0e0 OR {risk} >= 0.9e0 THEN 'CRITICAL'
             WHEN {g} >= 6.0e0 OR {total} >= 7.0e0 OR {risk} >= 0.7e0 THEN 'HIGH'
             WHEN {g} >= 4.0e0 OR {total} >= 5.0e0 OR {risk} >= 0.5e0 THEN 'MEDIUM'
             ELSE 'LOW' END"""


def _report(crash: str, ctype: str, risk: str, total: str, extra: str = ", message_id") -> str:
    return _q(f"""SELECT
        'CRASH-' || regexp_replace(policy_id, '[^A-Za-z0-9]', '', 'g') || '-'
            || CAST(event_millis AS VARCHAR) AS report_id,
        policy_id, vin, ts_text AS crash_timestamp, {ctype} AS crash_type,
        {_severity('g_force', total, risk)} AS severity_level,
        {total} AS impact_details_total_g_force,
        lateral_g_force AS impact_details_lateral_g_force,
        vertical_g_force AS impact_details_vertical_g_force,
        speed_mph AS impact_details_speed_at_impact,
        ax AS impact_details_acceleration_vector_x, ay AS impact_details_acceleration_vector_y,
        az AS impact_details_acceleration_vector_z,
        {total} AS impact_details_acceleration_vector_magnitude,
        CASE WHEN g_force > 2.0e0 THEN speed_mph * (g_force / 4.0e0) ELSE 0.0e0 END
            AS impact_details_deceleration_rate,
        lat AS location_latitude, lon AS location_longitude,
        current_street AS location_current_street, round(heading, 6) AS location_heading,
        CAST(NULL AS DOUBLE) AS location_accuracy_meters,
        vin AS vehicle_data_vin, speed_mph AS vehicle_data_speed_mph,
        round(heading, 6) AS vehicle_data_heading,
        ax AS sensor_analysis_accelerometer_raw_values_x,
        ay AS sensor_analysis_accelerometer_raw_values_y,
        az AS sensor_analysis_accelerometer_raw_values_z,
        {total} AS sensor_analysis_accelerometer_raw_values_magnitude,
        {total} AS sensor_analysis_accelerometer_total_magnitude,
        lateral_g_force AS sensor_analysis_accelerometer_lateral_magnitude,
        vertical_g_force AS sensor_analysis_accelerometer_vertical_magnitude,
        gx AS sensor_analysis_gyroscope_x, gy AS sensor_analysis_gyroscope_y,
        gz AS sensor_analysis_gyroscope_z, gyro_magnitude AS sensor_analysis_gyroscope_magnitude,
        rollover AS sensor_analysis_gyroscope_indicates_rollover,
        spinning AS sensor_analysis_gyroscope_indicates_spinning,
        mx AS sensor_analysis_magnetometer_x, my AS sensor_analysis_magnetometer_y,
        mz AS sensor_analysis_magnetometer_z,
        round(heading, 6) AS sensor_analysis_magnetometer_heading_degrees,
        rollover AS sensor_analysis_rollover_detected,
        spinning AS sensor_analysis_spinning_detected,
        {risk} >= 0.8e0 OR g_force >= 6.0e0 AS emergency_recommended,
        {risk} AS risk_score, {total} AS total_g_force{extra}
      FROM g WHERE {crash} AND policy_id IS NOT NULL AND gps_present""")


_PATTERNS = """SELECT message_id, policy_id, vin, current_street, speed_mph, lat AS latitude,
        lon AS longitude, total_g_force, lateral_g_force, vertical_g_force, gyro_magnitude,
        round(heading_computed, 6) AS heading, batch_crash_type AS crash_type, risk_category
      FROM g WHERE batch_is_crash"""

_STORAGE = f"""SELECT policy_id, date, count(*) AS record_count, {_mean('speed_mph')} AS avg_speed,
        max(g_force) AS max_g_force, min(g_force) AS min_g_force FROM g GROUP BY policy_id, date"""

_WINDOWS = f"""SELECT
        strftime(make_timestamp((event_us // 30000000) * 30000000), '%Y-%m-%d %H:%M:%S') AS window_start,
        policy_id, {_mean('speed_mph')} AS avg_speed, max(g_force) AS max_g_force,
        min(g_force) AS min_g_force, {_mean('risk_weight')} AS avg_risk_score,
        count(*) AS message_count
        FROM g WHERE NOT batch_is_crash {{where}} GROUP BY 1, policy_id"""

_DAILY = "SELECT date, count(*) AS total_records FROM g GROUP BY date"

ORACLE.update({
    "crash_reports_flat": _report("msg_is_crash", "msg_crash_type", "risk_score", "g_force"),
    "crash_reports_batch_flat": _report("batch_is_crash", "triage_type", "risk_weight",
                                        "total_g_force"),
    "crash_alerts": _q("""SELECT message_id, msg_crash_type AS crash_type, policy_id, vin,
        ts_text AS timestamp, current_street, lat AS latitude, lon AS longitude, accuracy,
        satellites AS satellite_count, gps_quality, altitude, bearing, cardinal_direction,
        speed_mph, g_force, lateral_g_force, vertical_g_force, ax AS accel_x, ay AS accel_y,
        az AS accel_z, gx AS pitch, gy AS roll, gz AS yaw, motion_type, gyro_magnitude,
        round(heading, 6) AS heading, pressure AS barometric_pressure,
        CASE WHEN pressure IS NOT NULL THEN round(estimated_altitude_m, 6) END AS estimated_altitude_m,
        weather_event, high_altitude, device_health_status, battery_percentage, signal_quality,
        orientation, screen_active, is_charging AS charging,
        CASE WHEN critical_battery THEN 'CRITICAL_BATTERY' WHEN low_battery THEN 'LOW_BATTERY'
             END AS battery_warning,
        weak_signal, rollover, spinning FROM g WHERE msg_is_crash"""),
    "crash_triage": _q("""SELECT message_id, policy_id, g_force, speed_mph,
        triage_type AS crash_type, severity_priority FROM g WHERE batch_is_crash"""),
    "crash_patterns": _q(_PATTERNS),
    "top_patterns": _q(_PATTERNS + " ORDER BY gyro_magnitude DESC, total_g_force DESC, message_id LIMIT 5"),
    "crash_events": _q("""SELECT message_id, policy_id, total_g_force, batch_crash_type AS crash_type
        FROM g WHERE batch_is_crash"""),
    "normal_events": _q("""SELECT message_id, policy_id, total_g_force, speed_mph
        FROM g WHERE NOT batch_is_crash"""),
    "driving_stats": _q(f"""SELECT policy_id, {_mean('speed_mph')} AS avg_speed,
        max(g_force) AS max_g_force, min(g_force) AS min_g_force,
        {_mean('risk_weight')} AS avg_risk_score, count(*) AS message_count
        FROM g WHERE NOT batch_is_crash GROUP BY policy_id"""),
    "storage_stats": _q(_STORAGE),
    "top_storage": _q(_STORAGE + " ORDER BY date DESC, record_count DESC, policy_id ASC NULLS FIRST LIMIT 10"),
    "daily_counts": _q(_DAILY),
    "archive_daily_counts": _q(_DAILY),
    "patterns_compared": _q("""SELECT message_id, CASE WHEN batch_is_crash THEN batch_crash_type END AS usual_type,
          CASE WHEN strict THEN strict_type END AS strict_type
        FROM (SELECT *, total_g_force >= 2.5e0 OR (speed_mph <= 5.0e0 AND total_g_force >= 2.0e0) OR gyro_magnitude >= 4.0e0
                  OR lateral_g_force >= 1.5e0 OR vertical_g_force >= 2.0e0 AS strict,
                CASE WHEN gyro_magnitude >= 4.0e0 THEN 'ROLLOVER' WHEN abs(gz) >= 2.0e0 THEN 'SPINNING'
                     WHEN lateral_g_force >= 1.5e0 THEN 'SIDE_IMPACT' WHEN vertical_g_force >= 2.0e0 THEN 'VERTICAL_IMPACT'
                     WHEN speed_mph <= 5.0e0 AND total_g_force >= 2.0e0 THEN 'SUDDEN_STOP'
                     WHEN total_g_force >= 2.5e0 THEN 'HIGH_G_FORCE' ELSE 'UNKNOWN' END AS strict_type
              FROM g)
        WHERE batch_is_crash OR strict"""),
    "recent_days": _q(_DAILY + " ORDER BY date DESC LIMIT 7"),
    "batch_summary": _q("""SELECT count(*) AS rows,
        count(*) FILTER (WHERE event_us IS NOT NULL) AS good_rows,
        count(*) FILTER (WHERE event_us IS NULL) AS quarantined,
        count(*) FILTER (WHERE event_us IS NOT NULL AND msg_is_crash) AS message_crashes,
        count(*) FILTER (WHERE event_us IS NOT NULL AND batch_is_crash) AS batch_crashes,
        count(*) FILTER (WHERE event_us IS NOT NULL AND batch_is_crash) AS risk_events,
        count(DISTINCT policy_id) FILTER (WHERE event_us IS NOT NULL) AS policies FROM s"""),
    "quarantine": _q("""SELECT message_id, 'bad_timestamp' AS reason FROM s WHERE event_us IS NULL
        UNION ALL
        SELECT message_id, CASE WHEN policy_id IS NULL THEN 'report_missing_policy_id'
                                ELSE 'report_missing_gps' END AS reason
        FROM g WHERE msg_is_crash AND (policy_id IS NULL OR NOT gps_present)"""),
    "accident_alerts": _q("""SELECT message_id, policy_id, vin,
        strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time_utc, g_force, speed_mph,
        lat AS latitude, lon AS longitude, current_street, 'potential_accident' AS alert_type
        FROM g WHERE g_force > 4.0e0"""),
    "driving_stats_30s": _q(_WINDOWS.format(where="")),
    "stream_window_stats": _q(_WINDOWS.format(where="")),
    "stream_late_windows": _q(_WINDOWS.format(where="")),
    "g_force_reconciliation": _q(f"""SELECT policy_id, count(*) AS messages,
        count(*) FILTER (WHERE abs(g_force - total_g_force) > 0.5e0) AS mismatches,
        round(count(*) FILTER (WHERE abs(g_force - total_g_force) > 0.5e0) / count(*), 6) AS mismatch_rate,
        {_mean('abs(g_force - total_g_force)')} AS avg_abs_diff FROM g GROUP BY policy_id"""),
    "g_force_mismatches": _q("""SELECT message_id, policy_id, vin, g_force,
        round(total_g_force, 6) AS total_g_force, round(abs(g_force - total_g_force), 6) AS abs_diff
        FROM g WHERE abs(g_force - total_g_force) > 0.5e0"""),
    "speed_reconciliation": _q(f"""SELECT policy_id, count(*) AS fixes,
        count(*) FILTER (WHERE abs(gps_speed_mph - speed_mph) > 5.0e0) AS mismatches,
        {_mean('abs(gps_speed_mph - speed_mph)')} AS avg_abs_diff_mph,
        round(max(abs(gps_speed_mph - speed_mph)), 6) AS max_abs_diff_mph
        FROM g WHERE gps_present AND gps_speed IS NOT NULL GROUP BY policy_id"""),
    "trip_distance": _q(""", seg AS (
          SELECT vin, lat, lon,
            CASE WHEN vin IS NOT NULL THEN lag(lat) OVER w END AS plat,
            CASE WHEN vin IS NOT NULL THEN lag(lon) OVER w END AS plon
          FROM g WHERE gps_present
          WINDOW w AS (PARTITION BY vin ORDER BY event_us, message_id)),
        d AS (
          SELECT vin, plat,
            6371000.0e0 * 2.0e0 * atan2(sqrt(a), sqrt(1.0e0 - a)) AS m
          FROM (SELECT vin, plat,
                  sin(radians(lat - plat) / 2) * sin(radians(lat - plat) / 2)
                  + cos(radians(plat)) * cos(radians(lat)) * sin(radians(lon - plon) / 2)
                    * sin(radians(lon - plon) / 2) AS a
                FROM seg))
        SELECT vin, count(*) AS fixes, count(plat) AS segments,
          round(coalesce(sum(m), 0.0e0), 3) AS total_distance_m, round(max(m), 3) AS max_segment_m
        FROM d GROUP BY vin"""),
    "magnetic_anomalies": _q(""", b AS (
          SELECT vin, CAST(sum(CAST(mag_magnitude AS DECIMAL(28, 9))) AS DOUBLE) / count(*) AS baseline_magnitude
          FROM g GROUP BY vin)
        SELECT message_id, g.vin, round(mag_magnitude, 6) AS mag_magnitude,
          round(baseline_magnitude, 6) AS baseline_magnitude,
          round(abs(mag_magnitude - baseline_magnitude), 6) AS deviation
        FROM g JOIN b ON g.vin IS NOT DISTINCT FROM b.vin
        WHERE abs(mag_magnitude - baseline_magnitude) > 50.0e0"""),
})

ORACLE["stream_open_windows"] = _q(""", o AS (
          SELECT *, (row_number() OVER (ORDER BY event_us NULLS FIRST, message_id) - 1) // ((SELECT count(*) + 2 FROM s) // 3) AS k FROM s),
        n AS (SELECT k, policy_id, event_us, event_us // 30000000 * 30000000 AS w FROM o WHERE event_us IS NOT NULL AND NOT batch_is_crash),
        b AS (SELECT batch_id, coalesce((SELECT max(event_us) // 1000 * 1000 - 600000000 FROM n WHERE k < batch_id), 0) AS late
              FROM range(3) t(batch_id))
        SELECT DISTINCT batch_id, strftime(make_timestamp(w), '%Y-%m-%d %H:%M:%S') AS window_start, policy_id
        FROM b JOIN n ON n.k <= batch_id AND w + 30000000 > late""")
ORACLE["stream_trips"] = ORACLE["trip_distance"]
ORACLE["stream_magnetic_running"] = _q(""", b AS (
          SELECT message_id, vin, mag_magnitude,
            CAST(sum(CAST(mag_magnitude AS DECIMAL(28, 9))) OVER w AS DOUBLE) / count(*) OVER w AS baseline_magnitude
          FROM g WINDOW w AS (PARTITION BY vin ORDER BY event_us, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT message_id, vin, round(mag_magnitude, 6) AS mag_magnitude, round(baseline_magnitude, 6) AS baseline_magnitude,
          round(abs(mag_magnitude - baseline_magnitude), 6) AS deviation
        FROM b WHERE abs(mag_magnitude - baseline_magnitude) > 50.0e0""")


_LEAVES = """message_id, policy_id, vin, ts_text AS timestamp, speed_mph, current_street, g_force,
        ax AS acc_x, ay AS acc_y, az AS acc_z, gx AS gyro_x, gy AS gyro_y, gz AS gyro_z,
        mx AS mag_x, my AS mag_y, mz AS mag_z, {heading} AS mag_heading,
        lat AS gps_lat, lon AS gps_lon, {altitude} AS gps_altitude, gps_speed,
        {bearing} AS gps_bearing, accuracy AS gps_accuracy, {satellites} AS gps_satellites,
        {fix_time} AS gps_fix_time, pressure, battery AS battery_level, signal AS signal_strength,
        {orientation} AS orientation, {screen_on} AS screen_on, {charging} AS charging,
        gps_present AS has_gps, true AS has_magnetometer, true AS has_device,
        CASE WHEN event_us IS NULL THEN 'bad_timestamp' END AS reason"""
_FULL = dict(heading="heading_in", altitude="altitude", bearing="bearing", satellites="satellites",
             fix_time="fix_time", orientation="orientation", screen_on="screen_on",
             charging="charging")
_SAMPLE = dict(heading="CAST(NULL AS DOUBLE)", altitude="CAST(NULL AS DOUBLE)",
               bearing="CAST(NULL AS DOUBLE)", satellites="CAST(NULL AS INTEGER)",
               fix_time="CAST(NULL AS VARCHAR)", orientation="CAST(NULL AS VARCHAR)",
               screen_on="CAST(NULL AS BOOLEAN)", charging="CAST(NULL AS BOOLEAN)")
_STORED = """SELECT message_id, policy_id, vin, current_street, g_force, speed_mph,
        lat AS latitude, lon AS longitude, accuracy, gx AS pitch, gy AS roll, gz AS yaw,
        battery AS battery_level, strftime(event_time, '%Y') AS year,
        strftime(event_time, '%m') AS month, date, strftime(event_time, '%H') AS hour FROM g"""
_MSG_REPORT = ("msg_is_crash", "msg_crash_type", "risk_score", "g_force")

ORACLE.update({
    "json_ingest": _q("SELECT " + _LEAVES.format(**_FULL) + " FROM s"),
    "json_layouts": _q(" UNION ALL ".join(
        "SELECT " + _LEAVES.format(**cols) + f", '{name}' AS layout FROM s"
        for name, cols in (("code", _FULL), ("readme", _FULL), ("sample", _SAMPLE)))),
    "archive_roundtrip": _q(_STORED),
    "archive_fallback": _q(_STORED),
    "archive_policy_first": _q(_STORED),
    "archive_unpartitioned": _q(_STORED),
    "archive_json": _q(_STORED),
    "archive_csv": _q("""SELECT message_id, policy_id, vin, g_force, lat AS latitude, date,
        strftime(event_time, '%H') AS hour FROM g"""),
    "stream_archive": _q(_STORED),
    "stream_compaction": _q(_STORED),
    "stream_quarantine": ORACLE["quarantine"],
    "stream_bounded_batches": _report(*_MSG_REPORT),
    "stream_restart": _report(*_MSG_REPORT),
    "stream_trigger": _report(*_MSG_REPORT),
    "stream_outbox": _report(*_MSG_REPORT, extra=""),
    "stream_admission": _q("""SELECT batch_id, count(*) AS messages, count(DISTINCT message_id) AS distinct_messages,
        min(message_id) AS first_id, max(message_id) AS last_id
      FROM (SELECT *, (row_number() OVER (ORDER BY message_id) - 1) // 100 AS batch_id FROM s) GROUP BY batch_id"""),
    "stream_metrics": _q("""SELECT count(*) AS messages, count(*) FILTER (WHERE msg_is_crash) AS crashes FROM s"""),
    "reports_json_flat": _report(*_MSG_REPORT, extra=""", message_id, date AS report_date,
        strftime(event_time, '%H') AS report_hour"""),
    "published_null_fields": _q("""SELECT
        'CRASH-' || regexp_replace(policy_id, '[^A-Za-z0-9]', '', 'g') || '-' || CAST(event_millis AS VARCHAR) AS report_id,
        14 AS fields, true AS null_accuracy FROM g WHERE msg_is_crash AND policy_id IS NOT NULL AND gps_present"""),
    "json_damaged": _q("""SELECT CASE WHEN k <> 1 THEN message_id END AS message_id,
        CASE WHEN k NOT IN (1, 11) THEN policy_id END AS policy_id, CASE WHEN k NOT IN (1, 10) THEN vin END AS vin,
        CASE WHEN k IN (1, 2, 8) THEN 0.0e0 ELSE g_force END AS g_force,
        CASE WHEN k IN (1, 4, 9) THEN NULL WHEN k = 3 AND screen_on IS NOT NULL THEN true ELSE screen_on END AS screen_on,
        k NOT IN (1, 4, 7) AS has_magnetometer, k NOT IN (1, 4, 9) AS has_device,
        CASE WHEN k = 1 THEN 'malformed_json' WHEN k = 8 THEN 'bad_value' WHEN k = 4 THEN 'missing_sensors'
             WHEN k = 5 THEN 'missing_accelerometer' WHEN k = 6 THEN 'missing_gyroscope'
             WHEN event_us IS NULL THEN 'bad_timestamp'
             WHEN crash AND (policy_id IS NULL OR k = 11) THEN 'report_missing_policy_id'
             WHEN crash AND NOT gps_present THEN 'report_missing_gps'
             WHEN crash AND k = 7 THEN 'report_missing_magnetometer' END AS reason
      FROM (SELECT *, message_id % 23 AS k,
              -- the rule again for what damage changes: no reported g, no device issues
              CASE WHEN message_id % 23 = 2 THEN rollover OR spinning OR lateral_g_force >= 3.0e0 OR vertical_g_force >= 2.0e0
                   WHEN message_id % 23 = 9 THEN g_force >= (CASE WHEN environmental_risk THEN 4.0e0 * 0.9e0 ELSE 4.0e0 END)
                        * (CASE WHEN gps_reliable THEN 1.0e0 ELSE 1.1e0 END)
                        OR (speed_mph <= 5.0e0 AND g_force >= 2.0e0) OR rollover OR spinning
                        OR lateral_g_force >= 3.0e0 OR vertical_g_force >= 2.0e0
                   ELSE msg_is_crash END AS crash FROM s)"""),
    "reports_roundtrip": _report(*_MSG_REPORT, extra=""", message_id, date AS report_date,
        strftime(event_time, '%H') AS report_hour"""),
    "published_reports": _report(*_MSG_REPORT, extra=""),
    "stream_equals_batch": _report(*_MSG_REPORT),
    "foreach_batch_reports": _report(*_MSG_REPORT),
})
