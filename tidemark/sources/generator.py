"""Deterministic synthetic commerce events."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import bronze_key
from tidemark.schemas import EVENT_TYPES
from tidemark.sources.sinks import append_partitions

# Fixed values of the event sequence.
MULTIPLIER = 1103515245
STEP = 12345
MASK = 0x7FFFFFFF
SKUS = ("SKU-100", "SKU-200", "SKU-300", "SKU-400")
COUNTRIES = ("US", "DE", "IN", "BR", "JP")
ORIGIN = datetime(2026, 1, 1, tzinfo=timezone.utc)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def events_at(df: DataFrame, index: str, seed: int = 42, start: datetime = ORIGIN) -> DataFrame:
    """The event of each position: column arithmetic, no state between rows."""
    i = F.col(index)
    n = (F.lit(seed).cast("bigint") * MULTIPLIER + i * STEP).bitwiseAND(F.lit(MASK).cast("bigint"))
    base = int((start if start.tzinfo else start.replace(tzinfo=timezone.utc)).timestamp())
    rows = df.select(i.cast("bigint").alias("_i"), n.alias("_n"))
    n = F.col("_n")
    position = F.col("_i").cast("string")
    return rows.select(
        F.concat(
            F.lit(f"evt-{seed:04d}-"), F.when(F.length(position) < 6, F.lpad(position, 6, "0")).otherwise(position)
        ).alias("event_id"),
        F.timestamp_seconds(F.lit(base) + F.col("_i") * 60).alias("event_ts"),
        _pick(EVENT_TYPES, n).alias("event_type"),
        F.concat(F.lit("user-"), F.lpad((F.floor(n / 7) % 50).cast("string"), 3, "0")).alias("user_id"),
        _pick(SKUS, n).alias("sku"),
        (n % 5 + 1).alias("quantity"),
        F.round((n % 90 + 10) * 1.25, 2).alias("amount_usd"),
        _pick(COUNTRIES, n).alias("country"),
    )


def generate_events(spark: SparkSession, count: int, seed: int = 42, start: datetime = ORIGIN) -> DataFrame:
    if count < 0:
        raise ValueError("count must be >= 0")
    return events_at(spark.range(count), "id", seed, start)


def as_json(events: DataFrame) -> DataFrame:
    """Events as Bronze JSON text with their day and key column."""
    stamp = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ssXXX")
    fields = [stamp.alias(c) if c == "event_ts" else F.col(c) for c in events.columns]
    return events.select(
        F.to_json(F.struct(*fields)).alias("raw"),
        F.date_format("event_ts", "yyyy-MM-dd").alias("dt"),
        "event_id",
        "user_id",
    )


def seed_bronze(spark: SparkSession, count: int, path: str, seed: int = 42) -> DataFrame:
    """Generate events and land them in Bronze by day; returns the landed rows."""
    landed = as_json(generate_events(spark, count, seed))
    key = bronze_key(F.col("dt"), F.col("event_id"))
    rows = landed.select("raw", key.alias("source_key"), F.current_timestamp().alias("landed_at"), "dt")
    append_partitions(rows, path, ("dt",))
    return rows
