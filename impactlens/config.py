"""Rule parameters and storage settings.

The defaults are the fixed values the detection rules are defined with;
every operator takes them as parameters so a deployment can tune them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values (must stay equal to the rule definitions) -----------------
# Standard gravity used to turn m/s^2 into g.
GRAVITY = 9.81
# Sea-level pressure (hPa) and exponent of the barometric altitude formula.
SEA_LEVEL_HPA = 1013.25
BARO_EXPONENT = 0.1903
BARO_SCALE_M = 44330.0
# Earth radius in metres for the haversine distance.
EARTH_RADIUS_M = 6371000.0
# m/s to mph factor.
MS_TO_MPH = 2.237
# Crash-type risk weights of the batch profile, in rule order.
RISK_WEIGHTS = (
    ("ROLLOVER", 1.0),
    ("SPINNING", 0.95),
    ("SIDE_IMPACT", 0.9),
    ("VERTICAL_IMPACT", 0.85),
    ("HIGH_G_FORCE", 0.8),
    ("SUDDEN_STOP", 0.7),
)
RISK_WEIGHT_DEFAULT = 0.1
# Archive partition layouts by policy and by severity.
POLICY_FIRST_PARTITIONS = ("policy_id", "year", "month", "date")
REPORT_PARTITIONS = ("severity_level", "report_date")
# ---------------------------------------------------------------------------

# Default layout: by date alone. With the policy first, a fleet makes one
# folder per policy and day; ask for POLICY_FIRST_PARTITIONS to get that.
TELEMETRY_PARTITIONS = ("year", "month", "date")


@dataclass(frozen=True)
class Thresholds:
    """Detection thresholds (g, mph, rad/s)."""

    g_force: float = 4.0
    speed: float = 5.0
    sudden_stop_g: float = 2.0
    rollover: float = 3.0
    spinning: float = 2.0
    pitching: float = 2.0
    unstable: float = 1.0
    lateral: float = 3.0
    vertical: float = 2.0
    # message profile: adaptive threshold factors
    weather_factor: float = 0.9
    unreliable_factor: float = 1.1
    # environment
    weather_low_hpa: float = 980.0
    weather_high_hpa: float = 1050.0
    high_altitude_hpa: float = 900.0
    gps_high_altitude_m: float = 1000.0
    # GPS quality
    accuracy_m: float = 5.0
    min_satellites: int = 4
    # device health
    low_battery: float = 20.0
    critical_battery: float = 10.0
    weak_signal_dbm: int = -80


DEFAULT_THRESHOLDS = Thresholds()


@dataclass(frozen=True)
class StorageConfig:
    """Archive settings: format, layout, codec and save mode."""

    path: str
    fmt: str = "parquet"
    partition_cols: tuple[str, ...] = field(default=TELEMETRY_PARTITIONS)
    partitioning_enabled: bool = True
    compression: str = "snappy"
    mode: str = "append"
    enabled: bool = True
    # Cap on rows per output file (None: Spark's session setting).
    max_records_per_file: int | None = None
