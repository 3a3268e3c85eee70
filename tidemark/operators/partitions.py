"""Partition grids, discovered partitions, objects per partition."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.schemas import EVENT_TYPES


def grid(days: DataFrame, enum_key: str, values: tuple[str, ...] = EVENT_TYPES, date_key: str = "dt") -> DataFrame:
    """Every enum value on every day between two dates, both included.

    ``days`` holds one row of `start` and `end` dates. Two generators make the
    product, so no join is involved; end before start is an error.
    """
    ok = F.when(F.col("end") < F.col("start"), F.raise_error(F.lit("end date must be on or after start date")))
    span = F.coalesce(ok.cast("array<date>"), F.sequence(F.col("start"), F.col("end")))
    by_day = days.select(F.explode(span).alias("_day"))
    return by_day.select(
        F.explode(F.array(*[F.lit(v) for v in values])).alias(enum_key),
        F.date_format("_day", "yyyy-MM-dd").alias(date_key),
    )


def projected_partitions(
    spark: SparkSession,
    enum_key: str,
    start: date,
    end: date,
    values: tuple[str, ...] = EVENT_TYPES,
    date_key: str = "dt",
) -> DataFrame:
    if end < start:
        raise ValueError("end date must be on or after start date")
    bounds = spark.range(1).select(F.lit(start).alias("start"), F.lit(end).alias("end"))
    return grid(bounds, enum_key, values, date_key)


def discovered(keys: DataFrame, columns: tuple[str, ...], key: str = "key", ordered: bool = True) -> DataFrame:
    """Distinct Hive partitions present in a set of object keys."""
    parts = keys.select(*[K.hive_value(F.col(key), c).alias(c) for c in columns])
    present = parts.filter(F.coalesce(*columns).isNotNull()).distinct()
    return present.orderBy(*sorted(columns)) if ordered else present


def objects_per_partition(
    inventory: DataFrame, columns: tuple[str, ...], required: tuple[str, ...] | None = None, key: str = "path"
) -> DataFrame:
    """Object count and bytes of each partition of an inventory.

    Partition values come from the key. Rows without the required values are
    skipped, other missing values read 'unknown'. Paths are not gathered: a
    partition may hold any number of objects.
    """
    needed = columns if required is None else required
    parts = inventory.select(
        *[K.hive_value(F.col(key), c).alias(c) for c in columns],
        *([F.col("length")] if "length" in inventory.columns else [F.lit(0).cast("bigint").alias("length")]),
    )
    for name in needed:
        parts = parts.filter(F.col(name).isNotNull())
    return parts.groupBy(*[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("length").alias("bytes")
    )


def describe_zone(listing: DataFrame, zone: str, enum_key: str, start: date, end: date, key: str = "path") -> DataFrame:
    """Partitions of a zone as (zone, name, dt, expected, present): the window's grid beside what is stored."""
    expected = projected_partitions(listing.sparkSession, enum_key, start, end).withColumn("expected", F.lit(True))
    present = discovered(listing, (enum_key, "dt"), key, ordered=False).withColumn("present", F.lit(True))
    both = expected.join(present, [enum_key, "dt"], "full_outer")
    return both.select(
        F.lit(zone).alias("zone"),
        F.col(enum_key).alias("name"),
        "dt",
        F.coalesce("expected", F.lit(False)).alias("expected"),
        F.coalesce("present", F.lit(False)).alias("present"),
    )
