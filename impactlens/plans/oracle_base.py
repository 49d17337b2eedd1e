"""DuckDB SQL for the oracle check: the events-derived telemetry and the
enrichment/detection rules written independently in SQL.

``ENRICHED`` is a ``WITH`` prefix ending in the view ``e`` (all messages,
flat columns, enrichment + both rule profiles) and ``g`` (the rows that
pass quarantine). Queries in :mod:`impactlens.plans.oracle` append a
``SELECT`` to it. Literals are written as doubles (``4.0e0``) so both
engines evaluate the same IEEE operations.
"""

ISO_RE = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?([Zz]|[+-]\d{2}:\d{2})$"
EPOCH_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

RAW = f"""
fx AS (
  SELECT event_id AS i, event_id % 50 AS p, ts, user_id, epoch_us(ts) AS ts_us FROM events
),
raw AS (
  SELECT
    i AS message_id,
    CASE WHEN p IN (20, 32) THEN NULL ELSE 'POL-' || CAST(user_id AS VARCHAR) END AS policy_id,
    'VIN' || lpad(CAST(user_id AS VARCHAR), 14, '0') AS vin,
    CASE WHEN p = 41 THEN 'not-a-time'
         WHEN p = 43 THEN '2024-01-05'
         WHEN p = 44 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
         WHEN i % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
         WHEN i % 3 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
         ELSE CAST(ts_us // 1000000 AS VARCHAR) || '.'
              || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0') || '000' END AS ts_text,
    CASE WHEN p IN (5, 21, 29) THEN 3.0e0 WHEN p = 35 THEN 5.0e0
         ELSE 5.1e0 + ((i * 7) % 700) / 10.0e0 END AS speed_mph,
    CASE i % 4 WHEN 0 THEN 'Harbour Rd' WHEN 1 THEN 'Mill Lane' WHEN 2 THEN 'Oak Ave'
         ELSE '5th Ave' END AS current_street,
    CASE WHEN p = 5 THEN 2.5e0 WHEN p IN (6, 32, 33) THEN 5.0e0
         WHEN p IN (7, 19, 25, 26, 27) THEN 4.2e0 WHEN p = 8 THEN 3.7e0 WHEN p = 9 THEN 4.0e0
         WHEN p = 12 THEN 9.0e0 WHEN p = 21 THEN 1.9e0 WHEN p = 24 THEN 6.5e0
         WHEN p = 30 THEN 3.96e0 WHEN p = 31 THEN 3.97e0 WHEN p = 35 THEN 2.0e0
         ELSE 0.9e0 + (i % 20) / 100.0e0 END AS g_force,
    CASE WHEN p IN (1, 13) THEN 32.0e0 WHEN p = 22 THEN 0.0e0 WHEN p = 28 THEN 29.0e0
         WHEN p = 29 THEN 18.0e0 ELSE ((i * 13) % 101 - 50) / 50.0e0 END AS ax,
    CASE WHEN p = 22 THEN 29.43e0 WHEN p = 28 THEN 0.0e0
         ELSE ((i * 17) % 101 - 50) / 50.0e0 END AS ay,
    CASE WHEN p = 2 THEN 32.0e0 WHEN p = 23 THEN 49.05e0 WHEN p = 28 THEN 29.0e0
         ELSE 9.81e0 END AS az,
    CASE WHEN p = 11 THEN 0.0e0 WHEN p = 14 THEN 2.2e0
         ELSE ((i * 19) % 101 - 50) / 200.0e0 END AS gx,
    CASE WHEN p IN (3, 13) THEN 3.5e0 WHEN p = 11 THEN 3.0e0
         ELSE ((i * 23) % 101 - 50) / 200.0e0 END AS gy,
    CASE WHEN p = 4 THEN 2.5e0 WHEN p = 10 THEN -2.0e0 WHEN p = 11 THEN 0.0e0
         ELSE ((i * 29) % 101 - 50) / 200.0e0 END AS gz,
    CAST((i * 41) % 101 - 50 AS DOUBLE) AS mx,
    CAST((i * 43) % 101 - 50 AS DOUBLE) AS my,
    CASE WHEN p = 39 THEN 200.0e0 ELSE 45.0e0 END AS mz,
    CASE WHEN p = 40 THEN 337.5e0 WHEN p = 45 THEN 22.5e0
         WHEN i % 5 = 0 THEN CAST((i * 9) % 360 AS DOUBLE) END AS heading_in,
    CASE WHEN p IN (8, 30, 31) THEN 970.0e0 WHEN p = 15 THEN 890.0e0 WHEN p = 16 THEN 1060.0e0
         WHEN p = 17 THEN NULL ELSE 1000.0e0 + (i % 30) END AS pressure,
    CASE WHEN p IN (7, 30, 31) THEN 15.0e0 WHEN p = 18 THEN 5.0e0
         ELSE 50.0e0 + (i % 50) END AS battery,
    CAST(CASE WHEN p = 19 THEN -95 ELSE -40 - i % 40 END AS INTEGER) AS signal,
    CASE WHEN p = 25 THEN 12.0e0 WHEN p = 26 THEN NULL
         ELSE 1.0e0 + (i % 40) / 10.0e0 END AS accuracy,
    CAST(CASE WHEN p = 27 THEN 3 ELSE 4 + i % 8 END AS INTEGER) AS satellites,
    p <> 33 AS gps_present,
    33.7e0 + ((i * 31) % 1000) / 10000.0e0 AS lat,
    -84.4e0 + ((i * 37) % 1000) / 10000.0e0 AS lon,
    CASE WHEN p = 36 THEN 1500.0e0 ELSE 300.0e0 + (i % 100) END AS altitude,
    i % 2 = 0 AS screen_default,
    i % 4 = 0 AS charging_default,
    CAST((i * 11) % 360 AS DOUBLE) AS bearing,
    CASE i % 3 WHEN 0 THEN 'portrait' WHEN 1 THEN 'LANDSCAPE' END AS orientation,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS fix_time,
    p
  FROM fx
),
t AS (
  SELECT message_id, policy_id, vin, ts_text, speed_mph, current_street, g_force,
    ax, ay, az, gx, gy, gz, mx, my, mz, heading_in, pressure, battery, signal,
    CASE WHEN gps_present THEN accuracy END AS accuracy,
    CASE WHEN gps_present THEN satellites END AS satellites,
    gps_present,
    CASE WHEN gps_present THEN lat END AS lat,
    CASE WHEN gps_present THEN lon END AS lon,
    CASE WHEN gps_present THEN altitude END AS altitude,
    CASE WHEN NOT gps_present OR p = 38 THEN NULL
         WHEN p = 37 THEN speed_mph / 2.237e0 + 10.0e0 ELSE speed_mph / 2.237e0 END AS gps_speed,
    CASE WHEN gps_present THEN bearing END AS bearing,
    CASE WHEN gps_present THEN fix_time END AS fix_time,
    orientation,
    CASE WHEN p = 46 THEN NULL ELSE screen_default END AS screen_on,
    CASE WHEN p = 47 THEN NULL ELSE charging_default END AS charging,
    CASE
      WHEN regexp_matches(ts_text, '{ISO_RE}')
        THEN epoch_us(try_cast(ts_text AS TIMESTAMPTZ))
      WHEN regexp_matches(ts_text, '{EPOCH_RE}') THEN
        CAST(trunc(try_cast(ts_text AS DOUBLE)) AS BIGINT) * 1000000
        + CAST(floor(CAST(trunc((try_cast(ts_text AS DOUBLE) - trunc(try_cast(ts_text AS DOUBLE)))
                                 * 1e9) AS BIGINT) / 1000) AS BIGINT)
    END AS event_us
  FROM raw
)"""

ENRICH = """
e1 AS (
  SELECT *,
    sqrt(ax * ax + ay * ay + az * az) / 9.81e0 AS total_g_force,
    sqrt(ax * ax + ay * ay) / 9.81e0 AS lateral_g_force,
    abs((az - 9.81e0) / 9.81e0) AS vertical_g_force,
    sqrt(gx * gx + gy * gy + gz * gz) AS gyro_magnitude,
    CASE WHEN degrees(atan2(my, mx)) < 0 THEN degrees(atan2(my, mx)) + 360.0e0
         ELSE degrees(atan2(my, mx)) END AS heading_computed,
    sqrt(mx * mx + my * my + mz * mz) AS mag_magnitude,
    CASE WHEN gps_present THEN coalesce(gps_speed * 2.237e0, 0.0e0) END AS gps_speed_mph,
    coalesce(accuracy <= 5.0e0, false) AS high_accuracy,
    coalesce(satellites >= 4, false) AS good_satellites,
    coalesce(altitude > 1000.0e0, false) AS gps_high_altitude,
    coalesce(pressure < 980.0e0 OR pressure > 1050.0e0, false) AS weather_event,
    coalesce(pressure < 900.0e0, false) AS high_altitude,
    CASE WHEN pressure IS NULL THEN 0.0e0
         ELSE 44330.0e0 * (1.0e0 - pow(pressure / 1013.25e0, 0.1903e0)) END AS estimated_altitude_m,
    coalesce(battery < 20.0e0, false) AS low_battery,
    coalesce(battery < 10.0e0, false) AS critical_battery,
    coalesce(signal < -80, false) AS weak_signal,
    CASE WHEN battery IS NULL THEN 0 ELSE CAST(trunc(battery) AS INTEGER) END AS battery_percentage,
    coalesce(lower(orientation) = 'portrait', false) AS portrait,
    coalesce(lower(orientation) = 'landscape', false) AS landscape,
    coalesce(screen_on, false) AS screen_active,
    coalesce(charging, false) AS is_charging,
    make_timestamp(event_us) AS event_time
  FROM t
),
e2 AS (
  SELECT *,
    abs(gy) > 3.0e0 OR gyro_magnitude > 3.0e0 AS rollover,
    abs(gz) > 2.0e0 AS spinning,
    abs(gx) > 2.0e0 AS pitching,
    CASE WHEN abs(gy) > 3.0e0 THEN 'ROLLING' WHEN abs(gz) > 2.0e0 THEN 'SPINNING'
         WHEN abs(gx) > 2.0e0 THEN 'PITCHING' WHEN gyro_magnitude > 1.0e0 THEN 'UNSTABLE'
         ELSE 'STABLE' END AS motion_type,
    coalesce(heading_in, heading_computed) AS heading,
    heading_in IS NOT NULL AS has_heading,
    CASE WHEN NOT gps_present THEN NULL WHEN NOT good_satellites THEN 'POOR'
         WHEN NOT high_accuracy THEN 'MODERATE' ELSE 'EXCELLENT' END AS gps_quality,
    CASE WHEN NOT gps_present THEN true ELSE high_accuracy AND good_satellites END AS gps_reliable,
    weather_event OR high_altitude AS environmental_risk,
    low_battery OR weak_signal AS device_issues,
    CASE WHEN critical_battery AND NOT is_charging THEN 'CRITICAL_BATTERY'
         WHEN low_battery AND NOT is_charging THEN 'LOW_BATTERY'
         WHEN weak_signal THEN 'WEAK_SIGNAL' ELSE 'HEALTHY' END AS device_health_status,
    CASE WHEN signal IS NULL THEN 'UNKNOWN' WHEN signal >= -50 THEN 'EXCELLENT'
         WHEN signal >= -60 THEN 'GOOD' WHEN signal >= -70 THEN 'FAIR'
         WHEN signal >= -80 THEN 'POOR' ELSE 'VERY_POOR' END AS signal_quality
  FROM e1
),
e3 AS (
  SELECT *,
    CASE WHEN heading >= 337.5e0 OR heading < 22.5e0 THEN 'N'
         WHEN heading >= 22.5e0 AND heading < 67.5e0 THEN 'NE'
         WHEN heading >= 67.5e0 AND heading < 112.5e0 THEN 'E'
         WHEN heading >= 112.5e0 AND heading < 157.5e0 THEN 'SE'
         WHEN heading >= 157.5e0 AND heading < 202.5e0 THEN 'S'
         WHEN heading >= 202.5e0 AND heading < 247.5e0 THEN 'SW'
         WHEN heading >= 247.5e0 AND heading < 292.5e0 THEN 'W'
         ELSE 'NW' END AS cardinal_direction,
    CASE WHEN device_issues OR NOT gps_reliable THEN
           (CASE WHEN environmental_risk THEN 4.0e0 * 0.9e0 ELSE 4.0e0 END) * 1.1e0
         ELSE (CASE WHEN environmental_risk THEN 4.0e0 * 0.9e0 ELSE 4.0e0 END) END AS g_threshold
  FROM e2
),
e AS (
  SELECT *,
    g_force >= g_threshold OR (speed_mph <= 5.0e0 AND g_force >= 2.0e0) OR rollover OR spinning
      OR lateral_g_force >= 3.0e0 OR vertical_g_force >= 2.0e0 AS msg_is_crash,
    CASE WHEN rollover THEN 'ROLLOVER' WHEN spinning THEN 'SPINNING'
         WHEN lateral_g_force >= 3.0e0 THEN 'SIDE_IMPACT'
         WHEN vertical_g_force >= 2.0e0 THEN 'VERTICAL_IMPACT'
         WHEN speed_mph <= 5.0e0 AND g_force >= 2.0e0 THEN 'SUDDEN_STOP'
         WHEN g_force >= 4.0e0 THEN 'HIGH_G_FORCE' ELSE 'UNKNOWN' END AS msg_crash_type,
    total_g_force >= 4.0e0 OR (speed_mph <= 5.0e0 AND total_g_force >= 2.0e0)
      OR gyro_magnitude >= 3.0e0 OR lateral_g_force >= 3.0e0 OR vertical_g_force >= 2.0e0
      AS batch_is_crash,
    CASE WHEN gyro_magnitude >= 3.0e0 THEN 'ROLLOVER' WHEN abs(gz) >= 2.0e0 THEN 'SPINNING'
         WHEN lateral_g_force >= 3.0e0 THEN 'SIDE_IMPACT'
         WHEN vertical_g_force >= 2.0e0 THEN 'VERTICAL_IMPACT'
         WHEN speed_mph <= 5.0e0 AND total_g_force >= 2.0e0 THEN 'SUDDEN_STOP'
         WHEN total_g_force >= 4.0e0 THEN 'HIGH_G_FORCE' ELSE 'UNKNOWN' END AS batch_crash_type,
    CASE WHEN gyro_magnitude >= 3.0e0 THEN 'ROLLOVER_RISK' WHEN abs(gz) >= 2.0e0 THEN 'SPINNING_RISK'
         WHEN lateral_g_force >= 3.0e0 THEN 'SIDE_IMPACT_RISK' ELSE 'NORMAL_RISK' END AS risk_category,
    CASE WHEN g_force > 8.0e0 THEN 'SEVERE_IMPACT' WHEN g_force > 4.0e0 THEN 'HIGH_G_FORCE'
         WHEN speed_mph < 5.0e0 AND g_force > 2.0e0 THEN 'SUDDEN_STOP' ELSE 'UNKNOWN' END AS triage_type,
    CASE WHEN g_force > 8.0e0 THEN 1 WHEN g_force > 6.0e0 THEN 2 WHEN g_force > 4.0e0 THEN 3
         ELSE 4 END AS severity_priority,
    strftime(event_time, '%Y-%m-%d') AS date,
    event_us // 1000 AS event_millis
  FROM e3
),
s AS (
  SELECT *,
    least(g_force * 10.0e0
      * (CASE WHEN rollover THEN 1.5e0 ELSE 1.0e0 END)
      * (CASE WHEN spinning THEN 1.3e0 ELSE 1.0e0 END)
      * (CASE WHEN lateral_g_force >= 3.0e0 THEN 1.2e0 ELSE 1.0e0 END)
      * (CASE WHEN vertical_g_force >= 2.0e0 THEN 1.1e0 ELSE 1.0e0 END)
      * (CASE WHEN weather_event THEN 1.2e0 ELSE 1.0e0 END)
      * (CASE WHEN high_altitude THEN 1.1e0 ELSE 1.0e0 END)
      * (CASE WHEN low_battery THEN 0.9e0 ELSE 1.0e0 END)
      * (CASE WHEN weak_signal THEN 0.9e0 ELSE 1.0e0 END), 100.0e0) AS risk_score,
    CASE batch_crash_type WHEN 'ROLLOVER' THEN 1.0e0 WHEN 'SPINNING' THEN 0.95e0
         WHEN 'SIDE_IMPACT' THEN 0.9e0 WHEN 'VERTICAL_IMPACT' THEN 0.85e0
         WHEN 'HIGH_G_FORCE' THEN 0.8e0 WHEN 'SUDDEN_STOP' THEN 0.7e0 ELSE 0.1e0 END AS risk_weight
  FROM e
),
g AS (SELECT * FROM s WHERE event_us IS NOT NULL)"""

ENRICHED = "WITH " + RAW.strip() + ",\n" + ENRICH.strip() + "\n"
