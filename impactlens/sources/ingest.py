"""Reading telemetry messages (JSON text) into the canonical frame.

* :func:`parse_telemetry` - JSON text in a ``value`` column -> canonical
  typed columns, tolerant the way a lenient JSON binder is: quoted numbers,
  floats for integers and numbers for strings are coerced; unknown fields
  are ignored; the three documented field layouts are merged. Well-formed
  messages, nearly all, are read with typed leaves; only one that such a
  reading rejects is read again as text and coerced. Columns that are not
  asked for (``fields``) are not parsed.
* :func:`read_telemetry` - the same from files, batch or streaming.
* :func:`with_event_time` - event time from the ``timestamp`` text.
* :func:`split_quarantine` - good rows and bad rows with a ``reason``.

Everything is a narrow projection: parsing happens in the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.cache import session_cached
from ..functions.columns import parse_event_time
from ..schema import RAW_TELEMETRY, RAW_TYPED

JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
    # NaN/Infinity tokens are not JSON; treat them as malformed input.
    "allowNonNumericNumbers": "false",
}

_PARSED, _CANONICAL = "_parsed", "_canonical"


class _Typed:
    """Leaves that the reader has typed already."""

    def num(self, value: Column, primitive: bool = False) -> Column:
        return F.coalesce(value, F.lit(0.0)) if primitive else value

    def _same(self, value: Column) -> Column:
        return value

    int_ = bool_ = long_ = _same

    def any_error(self) -> Column:
        return F.lit(False)


class _Coerce:
    """Builds typed leaves from raw text and remembers which failed."""

    def __init__(self) -> None:
        self.errors: list[Column] = []

    def _bad(self, text: Column, parsed: Column) -> None:
        """Text that is there, is not empty and does not parse is an error;
        an empty string counts as null."""
        self.errors.append((F.trim(text) != "") & parsed.isNull())

    def num(self, text: Column, primitive: bool = False) -> Column:
        v = F.trim(text).try_cast("double")
        self._bad(text, v)
        return F.coalesce(v, F.lit(0.0)) if primitive else v

    def int_(self, text: Column) -> Column:
        d = F.trim(text).try_cast("double")
        v = F.when(~F.isnan(d), d.try_cast("int"))
        self._bad(text, v)
        return v

    def bool_(self, text: Column) -> Column:
        t = F.lower(F.trim(text))
        # An integer is a boolean too: 0 is false, any other true.
        v = (F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))
             .otherwise(t.try_cast("long") != 0))
        self._bad(text, v)
        return v

    def long_(self, text: Column) -> Column:
        v = F.trim(text).try_cast("long")
        self._bad(text, v)
        return v

    def any_error(self) -> Column:
        out = F.lit(False)
        for e in self.errors:
            out = out | F.coalesce(e, F.lit(False))
        return out


#: Where each canonical column or part of ``sensors`` is found in a message.
_FOUND_IN = {
    "message_id": ("message_id",), "policy_id": ("policy_id", "policyId"), "vin": ("vin",),
    "timestamp": ("timestamp",), "speed_mph": ("speed_mph", "speedMph"),
    "current_street": ("current_street", "currentStreet"), "g_force": ("g_force", "gForce"),
    "sensors.gps": ("sensors.gps",), "sensors.accelerometer": ("sensors.accelerometer",),
    "sensors.gyroscope": ("sensors.gyroscope",), "sensors.magnetometer": ("sensors.magnetometer",),
    "sensors.barometric_pressure": ("sensors.barometric_pressure", "sensors.barometric"),
    "sensors.device": ("sensors.device", "sensors.deviceHealth"),
}
FIELDS = tuple(_FOUND_IN)


def _asked(fields: tuple[str, ...] | None) -> tuple[str, ...]:
    """The entries of ``FIELDS`` that ``fields`` names; ``sensors`` names all
    its parts."""
    if fields is None:
        return FIELDS
    unknown = [f for f in fields if f != "sensors" and f not in FIELDS]
    if unknown:
        raise ValueError(f"unknown fields {unknown}; there are {FIELDS}")
    return tuple(f for f in FIELDS if f in fields or (f.startswith("sensors.") and "sensors" in fields))


def _trimmed(schema: StructType, asked: tuple[str, ...]) -> StructType:
    """The raw schema with the fields that hold the asked ones."""
    paths = {path for name in asked for path in _FOUND_IN[name]} | {"_corrupt_record"}
    out = []
    for field in schema.fields:
        if field.name == "sensors":
            parts = [f for f in field.dataType.fields if f"sensors.{f.name}" in paths]
            if parts:
                out.append(StructField("sensors", StructType(parts)))
        elif field.name in paths:
            out.append(field)
    return StructType(out)


def canonical_columns(c: _Coerce | _Typed, raw: Column, asked: tuple[str, ...]) -> list[Column]:
    """Typed canonical columns from a parsed message."""
    def r(path: str) -> Column:
        at = raw
        for name in path.split("."):
            at = at[name]
        return at

    s = "sensors"
    gps, mag = f"{s}.gps", f"{s}.magnetometer"

    def xyz(base: str) -> Column:
        return F.when(r(base).isNotNull(), F.struct(
            *[c.num(r(f"{base}.{a}"), primitive=True).alias(a) for a in "xyz"]))

    def gps_struct() -> Column:
        return F.when(r(gps).isNotNull(), F.struct(
            c.num(F.coalesce(r(f"{gps}.lat"), r(f"{gps}.latitude")), True).alias("lat"),
            c.num(F.coalesce(r(f"{gps}.lon"), r(f"{gps}.longitude")), True).alias("lon"),
            c.num(r(f"{gps}.altitude")).alias("altitude"),
            c.num(F.coalesce(r(f"{gps}.speed"), r(f"{gps}.speed_ms"))).alias("speed"),
            c.num(r(f"{gps}.bearing")).alias("bearing"),
            c.num(r(f"{gps}.accuracy")).alias("accuracy"),
            c.int_(r(f"{gps}.satellite_count")).alias("satellite_count"),
            F.coalesce(r(f"{gps}.fix_time"), r(f"{gps}.gps_fix_time")).alias("fix_time"),
        ))

    def mag_struct() -> Column:
        return F.when(r(mag).isNotNull(), F.struct(
            *[c.num(r(f"{mag}.{a}"), primitive=True).alias(a) for a in "xyz"],
            c.num(r(f"{mag}.heading")).alias("heading")))

    def dev_struct() -> Column:
        dev = F.coalesce(r(f"{s}.device"), r(f"{s}.deviceHealth"))
        return F.when(dev.isNotNull(), F.struct(
            c.num(F.coalesce(dev["battery_level"], dev["batteryLevel"])).alias("battery_level"),
            c.int_(F.coalesce(dev["signal_strength"], dev["signalStrength"])).alias("signal_strength"),
            F.coalesce(dev["device_orientation"], dev["orientation"]).alias("device_orientation"),
            c.bool_(dev["screen_on"]).alias("screen_on"),
            c.bool_(dev["charging"]).alias("charging"),
        ))

    built = {
        "message_id": lambda: c.long_(r("message_id")),
        "policy_id": lambda: F.coalesce(r("policy_id"), r("policyId")),
        "vin": lambda: r("vin"),
        "timestamp": lambda: r("timestamp"),
        "speed_mph": lambda: c.num(F.coalesce(r("speed_mph"), r("speedMph")), True),
        "current_street": lambda: F.coalesce(r("current_street"), r("currentStreet")),
        "g_force": lambda: c.num(F.coalesce(r("g_force"), r("gForce")), True),
        "sensors.gps": gps_struct,
        "sensors.accelerometer": lambda: xyz(f"{s}.accelerometer"),
        "sensors.gyroscope": lambda: xyz(f"{s}.gyroscope"),
        "sensors.magnetometer": mag_struct,
        "sensors.barometric_pressure": lambda: c.num(F.coalesce(r(f"{s}.barometric_pressure"), r(f"{s}.barometric.pressure"))),
        "sensors.device": dev_struct,
    }
    columns = [built[name]().alias(name) for name in asked if not name.startswith("sensors.")]
    parts = [built[name]().alias(name.partition(".")[2]) for name in asked if name.startswith("sensors.")]
    if parts:
        columns.append(F.when(r(s).isNotNull(), F.struct(*parts)).alias(s))
    return columns


def _coerced(value_col: str, asked: tuple[str, ...]) -> Column:
    """The canonical struct of a message read as text, once (a lambda's
    variable is worked out once), and coerced."""
    def build(raw: Column) -> Column:
        c = _Coerce()
        columns = canonical_columns(c, raw, asked)
        return F.struct(*columns, raw["_corrupt_record"].alias("_corrupt_record"), c.any_error().alias("_type_error"))

    text = F.from_json(F.col(value_col), _trimmed(RAW_TELEMETRY, asked), JSON_OPTIONS)
    return F.get(F.transform(F.array(text), build), F.lit(0))


@session_cached
def _canonical(value_col: str, asked: tuple[str, ...]) -> Column:
    """The canonical struct of a message whose typed reading is in ``_PARSED``;
    a message that one rejects is coerced."""
    typed, parsed = _Typed(), F.col(_PARSED)
    strict = F.struct(*canonical_columns(typed, parsed, asked), F.lit(None).cast("string").alias("_corrupt_record"),
                      typed.any_error().alias("_type_error"))
    return F.when(parsed["_corrupt_record"].isNull(), strict).otherwise(_coerced(value_col, asked))


def parse_telemetry(df: DataFrame, value_col: str = "value", keep_value: bool = True,
                    carry: tuple[str, ...] = (), fields: tuple[str, ...] | None = None) -> DataFrame:
    """JSON text column -> canonical telemetry + ``_corrupt_record`` and
    ``_type_error`` helper columns (consumed by :func:`split_quarantine`);
    ``carry`` columns of the input are passed through. ``fields`` names the
    canonical columns (and parts of ``sensors``, as ``sensors.gps``) to read;
    only those are parsed and returned."""
    # Both steps go through a one-element explode: a predicate on generated
    # output cannot be pushed below the Generate, so the quarantine filter and
    # every field access read the struct that is there instead of Catalyst
    # substituting (and re-running) the parse once per field reference.
    asked = _asked(tuple(fields) if fields is not None else None)
    schema = _trimmed(RAW_TYPED, asked)
    parsed = df.select(F.col(value_col), *carry, F.explode(F.array(
        F.from_json(F.col(value_col), schema, JSON_OPTIONS))).alias(_PARSED))
    made = parsed.select(value_col, *carry, F.explode(F.array(_canonical(value_col, asked))).alias(_CANONICAL))
    extra = [F.col(value_col).alias("value")] if keep_value else []
    return made.select(f"{_CANONICAL}.*", *extra, *carry)


def canonicalise(df: DataFrame, value_col: str = "value") -> DataFrame:
    """One record shape from any of the three documented JSON layouts
    (alias of :func:`parse_telemetry`)."""
    return parse_telemetry(df, value_col)


#: A micro-batch of files where no other limit is asked for.
MAX_BYTES_PER_TRIGGER = 1 << 30


def read_telemetry(spark: SparkSession, path: str, streaming: bool = False,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """JSON-lines files (one message per line) -> canonical telemetry. A stream
    takes a number of files in each micro-batch, or ``MAX_BYTES_PER_TRIGGER``."""
    if streaming:
        reader = spark.readStream.format("text")
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        else:
            reader = reader.option("maxBytesPerTrigger", str(MAX_BYTES_PER_TRIGGER))
        return parse_telemetry(reader.load(path))
    return parse_telemetry(spark.read.text(path))


def with_event_time(df: DataFrame, text_col: str = "timestamp") -> DataFrame:
    return df.withColumn("event_time", _event_time_column(text_col))


@session_cached
def _event_time_column(text_col: str) -> Column:
    return parse_event_time(F.col(text_col))


def quarantine_reason(df: DataFrame) -> Column:
    """First failing check, or null for a good row."""
    return _reason_column(frozenset(c for c in ("_corrupt_record", "_type_error", "event_time")
                                    if c in df.columns))


@session_cached
def _reason_column(cols: frozenset) -> Column:
    expr = None

    def add(cond: Column, reason: str) -> None:
        nonlocal expr
        expr = F.when(cond, F.lit(reason)) if expr is None else expr.when(cond, F.lit(reason))

    if "_corrupt_record" in cols:
        add(F.col("_corrupt_record").isNotNull(), "malformed_json")
    if "_type_error" in cols:
        add(F.col("_type_error"), "bad_value")
    add(F.col("sensors").isNull(), "missing_sensors")
    add(F.col("sensors.accelerometer").isNull(), "missing_accelerometer")
    add(F.col("sensors.gyroscope").isNull(), "missing_gyroscope")
    if "event_time" in cols:
        add(F.col("event_time").isNull(), "bad_timestamp")
    return expr


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad). ``bad`` keeps the row and a ``reason``; helper columns
    are dropped from ``good``. Both are filters over the same lineage."""
    tagged = df.withColumn("reason", quarantine_reason(df))
    helpers = [c for c in ("_corrupt_record", "_type_error", "value") if c in df.columns]
    good = tagged.filter(F.col("reason").isNull()).drop("reason", *helpers)
    bad = tagged.filter(F.col("reason").isNotNull())
    return good, bad


def prepare(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """event time + quarantine split in one call."""
    return split_quarantine(with_event_time(df))
