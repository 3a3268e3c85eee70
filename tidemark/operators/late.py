"""Lookback windows, affected partitions, and the rebuild of Gold."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.days import in_window, utc_day, window_bounds
from tidemark.functions.keys import day_of_key
from tidemark.operators.gold import metric_columns
from tidemark.schemas import DEFAULT_LOOKBACK_DAYS


def events_in_window(events: DataFrame, start: date, end: date) -> DataFrame:
    """Events whose UTC day lies in the window."""
    return events.filter(utc_day(F.col("event_ts")).between(F.lit(start), F.lit(end)))


def partitions_in_window(silver: DataFrame, start: date, end: date) -> DataFrame:
    """Rows of the dt partitions in the window; prunes before any file is read."""
    return silver.filter(in_window(F.col("dt"), start, end))


def keys_in_window(keys: DataFrame, start: date, end: date, key: str = "key") -> DataFrame:
    """Object keys whose dt= segment lies in the window; others are dropped."""
    day = F.try_to_timestamp(day_of_key(F.col(key)), F.lit("yyyy-MM-dd"))
    return keys.filter(F.to_date(day).between(F.lit(start), F.lit(end)))


def affected_partitions(events: DataFrame, ordered: bool = True) -> DataFrame:
    """Distinct Gold partitions the events touch, by UTC day."""
    touched = events.select(
        "event_type", F.date_format(F.col("event_ts"), "yyyy-MM-dd").alias("dt")
    ).distinct()
    return touched.orderBy("event_type", "dt") if ordered else touched


def late_counts(silver: DataFrame, ordered: bool = True) -> DataFrame:
    grouped = silver.groupBy("event_type", "dt").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("_late")).alias("late_events")
    )
    return grouped.orderBy("dt", "event_type") if ordered else grouped


def partitions_meeting_window(silver: DataFrame, start: date, end: date) -> DataFrame:
    """Rows of the dt partitions that may hold an instant of the window; prunes before any file is read.

    A partition's day is the date in the event's own offset, which lies at most 14 hours
    from UTC, so the instants of a day are spread over it and one day either side.
    """
    return partitions_in_window(silver, start - timedelta(days=1), end + timedelta(days=1))


def rebuild_window(
    silver: DataFrame,
    as_of: datetime | date | str,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
) -> DataFrame:
    """Daily metrics of every partition with an event in [as_of - lookback, as_of].

    Computed from the full partitions, not from their rows inside the window or the late
    rows alone, so writing the result over those partitions is always right and
    repeatable. One aggregation finds the partitions and sums them.
    """
    start, end = window_bounds(as_of, lookback_days)
    inside = utc_day(F.col("event_ts")).between(F.lit(start), F.lit(end))
    sums = partitions_meeting_window(silver, start, end).groupBy("dt", "event_type").agg(
        *metric_columns(), F.count_if(inside).alias("_inside")
    )
    return sums.filter("_inside > 0").drop("_inside").orderBy("dt", "event_type")


def window_report(
    silver: DataFrame, as_of: datetime | date | str, lookback_days: int = DEFAULT_LOOKBACK_DAYS
) -> DataFrame:
    """Counters of a rebuild: rows in the window and how many are late."""
    start, end = window_bounds(as_of, lookback_days)
    return partitions_in_window(silver, start, end).agg(
        F.lit(lookback_days).alias("lookback_days"),
        F.lit(start.isoformat()).alias("window_start"),
        F.lit(end.isoformat()).alias("window_end"),
        F.count(F.lit(1)).alias("silver_in_window"),
        F.count_if("_late").alias("late_flagged"),
    )
