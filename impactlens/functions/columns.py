"""Native column expressions shared by the operators.

Every rule is a Catalyst expression (no Python UDF), so it is
code-generated, can be constant-folded and never leaves the JVM.

Comparisons with ``>``/``>=`` go through :func:`gt`/:func:`ge`: Spark orders
NaN above every number, while the rules are defined with IEEE semantics
where any comparison with NaN is false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (BARO_EXPONENT, BARO_SCALE_M, EARTH_RADIUS_M, GRAVITY,
                      SEA_LEVEL_HPA)


def lit_d(v: float) -> Column:
    return F.lit(float(v))


def gt(a: Column, b) -> Column:
    return (a > b) & ~F.isnan(a)


def ge(a: Column, b) -> Column:
    return (a >= b) & ~F.isnan(a)


def exact_avg(c: Column) -> Column:
    """Mean that does not depend on the order of the rows: the values are
    summed as fixed-point numbers of nine decimals and divided once. A value
    that no fixed-point number can hold (NaN, infinite) makes the mean NaN."""
    fixed = c.try_cast("decimal(28,9)")
    mean = F.sum(fixed).cast("double") / F.nullif(F.count(c), F.lit(0))
    return F.when(F.count_if(c.isNotNull() & fixed.isNull()) > 0, lit_d(float("nan"))).otherwise(mean)


def mean_parts(c: Column, name: str) -> list[Column]:
    """Aggregates that :func:`mean_of_parts` divides; those of several tables
    add up (:func:`merged_parts`) to the same mean as one table's."""
    fixed = c.try_cast("decimal(28,9)")
    return [F.sum(fixed).cast("decimal(38,9)").alias(f"{name}_sum"), F.count(c).alias(f"{name}_values"),
            F.count_if(c.isNotNull() & fixed.isNull()).alias(f"{name}_odd")]


def merged_parts(name: str) -> list[Column]:
    return [F.sum(f"{name}_{part}").cast(kind).alias(f"{name}_{part}")
            for part, kind in (("sum", "decimal(38,9)"), ("values", "long"), ("odd", "long"))]


def mean_of_parts(name: str) -> Column:
    """The mean of :func:`exact_avg` from its parts."""
    mean = F.col(f"{name}_sum").cast("double") / F.nullif(F.col(f"{name}_values"), F.lit(0))
    return F.when(F.col(f"{name}_odd") > 0, lit_d(float("nan"))).otherwise(mean)


def sq(c: Column) -> Column:
    return c * c


def magnitude(*cs: Column) -> Column:
    acc = sq(cs[0])
    for c in cs[1:]:
        acc = acc + sq(c)
    return F.sqrt(acc)


def total_g(x: Column, y: Column, z: Column) -> Column:
    return magnitude(x, y, z) / lit_d(GRAVITY)


def lateral_g(x: Column, y: Column) -> Column:
    return magnitude(x, y) / lit_d(GRAVITY)


def vertical_g(z: Column) -> Column:
    return F.abs((z - lit_d(GRAVITY)) / lit_d(GRAVITY))


def heading_from_field(mx: Column, my: Column) -> Column:
    d = F.degrees(F.atan2(my, mx))
    return F.when(d < 0, d + lit_d(360.0)).otherwise(d)


# Eight 45-degree compass sectors, lower bounds inclusive;
# N covers [337.5, 360) and [0, 22.5); anything left over (NaN) is NW.
_SECTORS = (("NE", 22.5, 67.5), ("E", 67.5, 112.5), ("SE", 112.5, 157.5),
            ("S", 157.5, 202.5), ("SW", 202.5, 247.5), ("W", 247.5, 292.5))


def cardinal(h: Column) -> Column:
    expr = F.when((h >= 337.5) | (h < 22.5), F.lit("N"))
    for name, lo, hi in _SECTORS:
        expr = expr.when((h >= lo) & (h < hi), F.lit(name))
    return F.when(h.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit("NW")))


def baro_altitude(p: Column) -> Column:
    return F.when(p.isNull(), lit_d(0.0)).otherwise(
        lit_d(BARO_SCALE_M) * (lit_d(1.0) - F.pow(p / lit_d(SEA_LEVEL_HPA), lit_d(BARO_EXPONENT))))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    la1, la2 = F.radians(lat1), F.radians(lat2)
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = (F.sin(dlat / 2) * F.sin(dlat / 2)
         + F.cos(la1) * F.cos(la2) * F.sin(dlon / 2) * F.sin(dlon / 2))
    c = lit_d(2.0) * F.atan2(F.sqrt(a), F.sqrt(lit_d(1.0) - a))
    return lit_d(EARTH_RADIUS_M) * c


def int_truncate(d: Column) -> Column:
    """Double to int the way a JVM narrowing cast does it: toward zero,
    saturating, NaN -> 0 (a plain cast raises under ANSI mode)."""
    clipped = F.greatest(F.least(d, lit_d(2147483647.0)), lit_d(-2147483648.0))
    return F.when(F.isnan(d), F.lit(0)).otherwise(clipped.cast("int"))


# Fixed patterns: ISO-8601 instants (Z or offset, optional seconds and
# fraction) and plain decimal epoch seconds.
ISO_INSTANT_RE = (r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
                  r"([Zz]|[+-]\d{2}:\d{2})$")
EPOCH_SECONDS_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_event_time(text: Column) -> Column:
    """ISO-8601 instant first, else epoch seconds as a double, else null.

    Epoch strings follow the double arithmetic of the definition: whole
    seconds by truncation, then nanoseconds from the truncated fraction, so
    '1753411278.026699000' lands on ...278.026699 (millis ...026).
    """
    # ISO instants are case-insensitive ('t', 'z'); seconds are optional.
    iso_text = F.regexp_replace(F.upper(text), r"(T\d{2}:\d{2})([Z+-])", "$1:00$2")
    iso = F.when(text.rlike(ISO_INSTANT_RE), iso_text.try_cast("timestamp"))
    d = text.try_cast("double")
    secs = d.try_cast("long")
    nanos = ((d - secs) * lit_d(1e9)).try_cast("long")
    micros = F.try_add(F.try_multiply(secs, F.lit(1000000)), F.floor(nanos / 1000))
    epoch = F.when(text.rlike(EPOCH_SECONDS_RE) & ~F.isnan(d), F.timestamp_micros(micros))
    return F.coalesce(iso, epoch)


def report_id(policy_id: Column, event_time: Column) -> Column:
    return F.concat(F.lit("CRASH-"), F.regexp_replace(policy_id, "[^A-Za-z0-9]", ""),
                    F.lit("-"), F.unix_millis(event_time).cast("string"))
