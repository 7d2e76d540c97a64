"""Calendar helpers over epoch milliseconds and per-row time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def local_date(ms: Column, zone: Column) -> Column:
    """Calendar date of an instant in the row's zone."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def start_of_local_day_ms(day: Column, zone: Column) -> Column:
    """First instant of a local day, in epoch ms (daylight saving is followed)."""
    return F.unix_millis(F.to_utc_timestamp(day.cast("timestamp"), zone))


def expires_at(ms: Column, ttl_ms: int) -> Column:
    return ms + F.lit(ttl_ms)


def is_expired(expires: Column, now_ms: Column) -> Column:
    return expires <= now_ms
