"""Timestamps: parsing, localisation, calendar parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: timestamp layouts tried after the configured one, in this order ---
TIMESTAMP_FORMATS = [
    "dd/MM/yyyy HH:mm",
    "yyyy-MM-dd HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "dd-MM-yyyy HH:mm:ss",
    "dd-MM-yyyy HH:mm",
]
ISO_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]
DAY_FIRST_FORMATS = ["dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm"]

# --- fixed values: time-of-day periods, left-closed ---
DAY_PERIODS = [("00_06", 0, 6), ("06_11", 6, 11), ("11_15", 11, 15), ("15_20", 15, 20), ("20_00", 20, 24)]

EXCEL_EPOCH = "1899-12-30"


def parse_timestamp(text: Column, fmt: str) -> Column:
    """Wall-clock timestamp, NULL when the text does not match ``fmt``."""
    return F.try_to_timestamp(F.trim(text), F.lit(fmt)).cast("timestamp_ntz")


def parse_timestamp_any(text: Column, formats: list[str] | None = None) -> Column:
    """First matching format wins, row by row."""
    return F.coalesce(*[parse_timestamp(text, fmt) for fmt in formats or TIMESTAMP_FORMATS])


def parse_timestamp_free(text: Column, timezone: str | None = None) -> Column:
    """Wall-clock timestamp of ISO text with ``T``, fractions or an offset; an offset is converted to ``timezone``.

    Without a zone the offset's own wall clock is kept.
    """
    iso = F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), F.trim(text))
    offset = iso.rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}(:?\d{2})?)$")
    wall = F.regexp_replace(iso, r"(Z|[+-]\d{2}(:?\d{2})?)$", "")
    plain = F.when(offset, wall).otherwise(iso).try_cast("timestamp_ntz")
    if timezone is None:
        return plain
    # the instant's clock in UTC is its own clock less the offset
    away = F.regexp_extract(iso, r"(Z|[+-]\d{2}(:?\d{2})?)$", 1)
    sign = F.when(away.startswith("-"), -1).otherwise(1)
    digits = F.rpad(F.regexp_replace(away, r"[^0-9]", ""), 4, "0")
    minutes = sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
    utc = plain - F.make_interval(mins=F.coalesce(minutes, F.lit(0)))
    return F.when(offset, F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc)).otherwise(plain)


def localize(wall: Column, timezone: str) -> Column:
    """Wall clock as the zone's clock shows it: a time inside the spring gap moves one hour forward."""
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), local_to_utc(wall, timezone))


def parse_timestamp_iso_first(text: Column) -> Column:
    """ISO layouts first, day-first layouts for what is left."""
    return parse_timestamp_any(text, ISO_FORMATS + DAY_FIRST_FORMATS)


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def local_to_utc(wall: Column, timezone: str) -> Column:
    """Instant (UTC wall clock) of a local wall clock.

    A time inside the spring gap moves one hour forward. Inside the autumn overlap the standard-time
    (second) occurrence is taken: Spark resolves to the first one, and one hour later by the clock of
    the instant is still the same local time exactly there.
    """
    first = F.to_utc_timestamp(wall.cast("timestamp"), timezone)
    later = first + F.expr("INTERVAL 1 HOUR")
    same_wall = F.from_utc_timestamp(later, timezone) == F.from_utc_timestamp(first, timezone)
    return F.when(same_wall, later).otherwise(first).cast("timestamp_ntz")


def floor_to_interval(ts: Column, minutes: int) -> Column:
    """Start of the slot of ``minutes`` that ``ts`` lies in, counted from the full hour."""
    wall = ts.cast("timestamp_ntz")
    past = F.make_interval(mins=F.minute(wall) % minutes, secs=F.extract(F.lit("SECOND"), wall))
    return wall - past


def day_period(hour: Column) -> Column:
    """Name of the time-of-day period of an hour."""
    first, *rest = DAY_PERIODS
    return reduce(
        lambda chain, p: chain.when((hour >= p[1]) & (hour < p[2]), p[0]),
        rest,
        F.when((hour >= first[1]) & (hour < first[2]), first[0]),
    )


def excel_serial_to_timestamp(serial: Column) -> Column:
    """Spreadsheet day number to wall-clock timestamp."""
    whole = F.floor(serial).cast("int")
    seconds = F.round((serial - F.floor(serial)) * 86400.0, 6).cast("decimal(18,6)")
    start = F.lit(EXCEL_EPOCH).cast("timestamp_ntz")
    return start + F.make_interval(days=whole, secs=seconds)


def day_fraction_to_time(fraction: Column) -> Column:
    """Fraction of a day to ``HH:mm:ss``; unusable input gives midnight."""
    hours = F.floor(fraction * 24)
    minutes = F.floor(F.pmod(fraction * 24 * 60, F.lit(60.0)))
    seconds = F.floor(F.pmod(fraction * 24 * 3600, F.lit(60.0)))
    return F.when(fraction.isNull(), "00:00:00").otherwise(F.format_string("%02d:%02d:%02d", hours, minutes, seconds))
