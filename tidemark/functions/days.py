"""Days, windows and ages."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import DEFAULT_LOOKBACK_DAYS


def utc_day(instant: Column) -> Column:
    return F.to_date(instant)


def as_day(value: datetime | date | str) -> date:
    """UTC calendar day of a parameter; a naive datetime counts as UTC."""
    if isinstance(value, str):
        value = parse_instant(value)
    if isinstance(value, datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return aware.astimezone(timezone.utc).date()
    return value


def parse_instant(text: str) -> datetime:
    parsed = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)


def window_bounds(as_of: datetime | date | str, lookback_days: int = DEFAULT_LOOKBACK_DAYS):
    """First and last day covered by a lookback window, both included."""
    end = as_day(as_of)
    return end - timedelta(days=lookback_days), end


def lookback_setting(text: Column) -> Column:
    """Lookback days from a setting: junk or a negative number gives 2."""
    days = strip_cast(text)
    return F.when(days >= 0, days).otherwise(F.lit(DEFAULT_LOOKBACK_DAYS).cast("bigint"))


def strip_cast(text: Column) -> Column:
    return text.cast("string").try_cast("bigint")


def watermark_setting(watermark: Column, as_of: Column) -> Column:
    """Watermark override of a trigger: the first non-blank of two ISO texts."""
    chosen = F.coalesce(F.nullif(watermark, F.lit("")), F.nullif(as_of, F.lit("")))
    return F.try_to_timestamp(chosen)


def in_window(day: Column, start: date, end: date) -> Column:
    """Inclusive window test on a DATE or an ISO day text.

    ISO day texts sort like dates, so the literal keeps the column bare and the
    test prunes partitions when the column is one.
    """
    return day.between(F.lit(start.isoformat()), F.lit(end.isoformat()))


def age_hours(as_of: Column, written: Column) -> Column:
    return F.round((F.unix_micros(as_of) - F.unix_micros(written)) / 3600000000.0, 3)


def age_days(as_of: Column, written: Column) -> Column:
    return F.round((F.unix_micros(as_of) - F.unix_micros(written)) / 86400000000.0, 3)
