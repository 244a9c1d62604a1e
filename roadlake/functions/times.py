"""Time columns: microseconds, seconds and the ISO text used in envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
# First and last second of the years 1 to 9999.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def from_epoch(seconds: Column) -> Column:
    """TIMESTAMP of epoch seconds, to the nearest microsecond; NULL out of range."""
    inside = seconds.between(FIRST_SECOND, LAST_SECOND) & ~F.isnan(seconds)
    return F.when(inside, F.timestamp_micros(F.rint(seconds * MICROS).cast("bigint")))


def iso_text(ts: Column) -> Column:
    """``2024-05-20T08:30:00``, with six decimals only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    parts = F.date_format(ts, ".SSSSSS")
    return F.when(parts == ".000000", whole).otherwise(F.concat(whole, parts))


def seconds_since_midnight(ts: Column) -> Column:
    return (F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))) / MICROS
