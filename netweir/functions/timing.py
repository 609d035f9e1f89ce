"""Time expressions: grid positions, durations, zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- fixed values: duration units and their nanoseconds ---
DURATION_UNITS = {
    "h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "µs": 1_000, "μs": 1_000, "ns": 1,
}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ntz(ts: Column) -> Column:
    """The wall-clock (UTC session) value without a zone."""
    return ts.cast("timestamp_ntz")


def grid_time(index: Column, step_s: int) -> Column:
    """Timestamp of grid position ``index``."""
    return F.timestamp_seconds(index * F.lit(step_s)).cast("timestamp_ntz")


def floor_div(value: Column, width: int) -> Column:
    """Integer floor division that is also right for negative numbers."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("long")


def bucket_start(ts: Column, width_s: int) -> Column:
    """Start of the epoch-aligned bucket that holds ``ts``."""
    us = micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(width_s * 1_000_000)))


def duration_seconds(text: Column, default_s: int | None = None) -> Column:
    """Seconds of a duration such as ``1h30m`` or ``-1.5s``, exact to the nanosecond.

    The whole text has to be an optional sign and numbers with units. Other text, NULL and a
    duration of nothing give ``default_s``, or 0 without one.
    """
    units = "|".join(sorted(DURATION_UNITS, key=len, reverse=True))
    number = r"[0-9]+\.?[0-9]*|\.[0-9]+"
    valid = text.rlike(rf"^[-+]?((?:{number})({units}))+$")
    parts = F.regexp_extract_all(text, F.lit(rf"({number})({units})"), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(rf"({number})({units})"), F.lit(2))
    scale = F.create_map(*[F.lit(x).cast("decimal(14,0)") if isinstance(x, int) else F.lit(x) for pair in DURATION_UNITS.items() for x in pair])
    # Decimals hold nine digits behind the point; what is smaller is less than a nanosecond.
    nanos = F.zip_with(parts, names, lambda n, u: F.floor(F.coalesce(n.try_cast("decimal(22,9)"), F.lit(0).cast("decimal(22,9)")) * scale[u]).cast("decimal(38,0)"))
    whole = F.aggregate(nanos, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    total = whole.cast("double") / F.lit(1e9) * F.when(text.startswith("-"), -1.0).otherwise(1.0)
    known = F.when(valid & (total != 0), total)
    return F.coalesce(known, F.lit(float(default_s or 0)))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, rounded to the nearest whole second."""
    return F.round((micros(end) - micros(start)) / F.lit(1_000_000)).cast("long")
