"""Daily metrics: aggregation, contract checks, merge of metric parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import keys as K
from tidemark.functions.payload import strip
from tidemark.operators.cleanse import failed_names
from tidemark.schemas import EVENT_TYPES


def metric_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("events"), F.round(F.sum("amount_usd"), 2).alias("amount_usd")]


def daily_metrics(silver: DataFrame, ordered: bool = True) -> DataFrame:
    """Events and revenue per (day, type).

    Partial and final hash aggregation on a small key, so one dominant type or
    day costs no more than another.
    """
    grouped = silver.groupBy("dt", "event_type").agg(*metric_columns())
    return grouped.orderBy("dt", "event_type") if ordered else grouped


def _integer(df: DataFrame, name: str) -> Column:
    """Integer reading of a column: text must be an integer, numbers truncate."""
    if name not in df.columns:
        return F.lit(0).cast("bigint")
    column = F.col(name)
    return (strip(column) if isinstance(df.schema[name].dataType, T.StringType) else column).try_cast("bigint")


def _double(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0.0)
    return F.col(name).try_cast("double")


def with_metric_faults(rows: DataFrame) -> DataFrame:
    """Add `reasons`, the contract faults of a daily-metric row.

    Measures that are not numbers end the list: their sign is not tested.
    """
    events, amount = _integer(rows, "events"), _double(rows, "amount_usd")
    numeric = events.isNotNull() & amount.isNotNull()
    dt = F.coalesce(strip(F.col("dt").cast("string")), F.lit(""))
    return rows.withColumn(
        "reasons",
        failed_names(
            {
                "missing_dt": dt == "",
                "unknown_event_type": ~F.coalesce(strip(F.col("event_type")).isin(*EVENT_TYPES), F.lit(False)),
                "non_numeric_measures": ~numeric,
                "non_positive_events": numeric & (events <= 0),
                "negative_amount": numeric & (amount < 0),
            }
        ),
    )


def accepted_metrics(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons")


def rejected_metrics(checked: DataFrame) -> DataFrame:
    """Rejected metric rows, reasons joined by '+'."""
    return checked.filter(F.size("reasons") > 0).select(
        F.array_join("reasons", "+").alias("reason"), *[c for c in checked.columns if c != "reasons"]
    )


def unreadable(inspected: DataFrame, source_key: str = "source_key") -> DataFrame:
    """Silver payloads that do not conform, as Gold quarantine rows."""
    return inspected.filter(F.array_contains("checks", "schema_valid")).select(
        F.lit("unreadable_silver").alias("reason"), F.col(source_key).alias("source_key"), F.col("raw").alias("payload")
    )


def quarantine_rows(unreadable_rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both kinds of Gold rejects in one frame, keyed for the quarantine layout."""
    metric_rows = rejected.select(
        "reason",
        K.or_unknown(F.col("event_type")).alias("metric"),
        K.or_unknown(F.col("dt").cast("string")).alias("dt"),
        F.to_json(F.struct("dt", "event_type", "events", "amount_usd")).alias("payload"),
    )
    silver_rows = unreadable_rows.select(
        "reason",
        F.lit("unknown").alias("metric"),
        F.lit("unknown").alias("dt"),
        F.to_json(F.struct("source_key", "payload")).alias("payload"),
    )
    return metric_rows.unionByName(silver_rows).withColumn("zone", F.lit("gold"))


def serving_rows(gold: DataFrame) -> DataFrame:
    """Gold rows keyed by event_type#dt."""
    return gold.select(
        K.metric_day(F.col("event_type"), F.col("dt")).alias("metric_day"),
        "event_type",
        "dt",
        "events",
        "amount_usd",
    )


def merge_metrics(parts: DataFrame, keys: tuple[str, ...] = ("event_type", "dt")) -> DataFrame:
    """Fold metric parts of a partition: sums, and how many parts went in."""
    return parts.groupBy(*keys).agg(
        F.coalesce(F.sum(_integer(parts, "events")), F.lit(0)).alias("events"),
        F.round(F.coalesce(F.sum(_double(parts, "amount_usd")), F.lit(0.0)), 4).alias("amount_usd"),
        F.count(F.lit(1)).alias("compacted_from"),
    )
