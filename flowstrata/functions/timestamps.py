"""ISO-8601 text to event time, without depending on the session time zone.

The wall clock is read as if it were UTC and the offset is subtracted, both as
microseconds, so that hour and date can be taken from the record's own clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_US = 1_000_000
_HOUR_US = 3_600 * _US
_DAY_US = 24 * _HOUR_US

# Accepted text: a date, optionally a time, and after a time optionally an
# offset. Group 1 is the clock reading.
ISO_PATTERN = (
    r"^(?!0000|.{10}[Z+-])"
    r"(\d{4}-\d{2}-\d{2}(?:[T ](?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:\.\d+)?)?)?)?)"
    r"(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)?$"
)


def clock_text_of(text: Column) -> Column:
    """The date and time part of an accepted text, empty for any other."""
    return F.regexp_extract(text, ISO_PATTERN, 1)


def _wall_micros(clock: Column) -> Column:
    # Completed to seconds; an empty clock becomes a date that does not exist.
    size = F.length(clock)
    rest = F.when(size < 19, F.substr(F.lit("0000-00-00T00:00:00Z"), size + 1)).otherwise("Z")
    return F.unix_micros(F.concat(clock, rest).try_cast("timestamp_ltz"))


def _offset_micros(text: Column, clock: Column) -> Column:
    zone = F.substr(text, F.length(clock) + 1)
    minutes = F.substring(zone, 2, 2).try_cast("bigint") * 60 + F.right(zone, F.lit(2)).try_cast("bigint")
    signed = F.when(zone.startswith("+"), minutes).when(zone.startswith("-"), -minutes)
    return F.coalesce(signed, F.lit(0).cast("bigint")) * (60 * _US)


def wall_micros(text: Column) -> Column:
    """Microseconds of the written clock reading; null if the text is no timestamp."""
    return _wall_micros(clock_text_of(text))


def parse_instant(text: Column) -> Column:
    """The instant named by ISO text, or null."""
    clock = clock_text_of(text)
    return instant(_wall_micros(clock), _offset_micros(text, clock))


def with_clock(df: DataFrame, text: str = "timestamp") -> DataFrame:
    """Adds ``_wall_us`` and ``_offset_us``, read once per row.

    They come out of a one-row generator: Catalyst pushes filters through
    projections by repeating their expressions, but not through a generator,
    so a later filter on them does not parse the text a second time.
    """
    clock = F.col("_clock")
    reading = F.struct(
        _wall_micros(clock).alias("_wall_us"), _offset_micros(F.col(text), clock).alias("_offset_us")
    )
    return (
        df.withColumn("_clock", clock_text_of(F.col(text)))
        .select("*", F.inline(F.array(reading)))
        .drop("_clock")
    )


def floor_to(micros: Column, unit: int) -> Column:
    return micros - F.pmod(micros, F.lit(unit).cast("bigint"))


def instant(wall: Column, offset: Column) -> Column:
    return F.timestamp_micros(wall - offset)


def hour_of(wall: Column, offset: Column) -> Column:
    return F.timestamp_micros(floor_to(wall, _HOUR_US) - offset)


def date_of(wall: Column) -> Column:
    days = F.floor(floor_to(wall, _DAY_US) / _DAY_US).cast("int")
    return F.date_from_unix_date(days)


def minute_of(ts: Column) -> Column:
    return F.timestamp_micros(floor_to(F.unix_micros(ts), 60 * _US))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(_US))


def as_instant(value: dt.datetime | str | Column | None) -> Column:
    """A moment given as datetime, ISO text or Column; the current time if none."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    micros = round((value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def iso_text(ts: Column) -> Column:
    """Instant as ISO text in UTC."""
    return F.concat(
        F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")),
                      "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit("+00:00"),
    )
