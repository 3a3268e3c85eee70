"""Expiry and compaction plans over partition and object inventories."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.days import age_days, as_day, parse_instant


def _per_dataset(setting: int | dict[str, int], least: int) -> Column:
    """A limit for all rows, or one looked up by the row's dataset."""
    if isinstance(setting, dict):
        pairs = [F.lit(x) for name, value in setting.items() for x in (name, max(int(value), least))]
        return F.try_element_at(F.create_map(*pairs), F.col("dataset"))
    return F.lit(max(int(setting), least))


def _labelled(partitions: DataFrame, dataset: str | None) -> DataFrame:
    return partitions if dataset is None else partitions.select(F.lit(dataset).alias("dataset"), *partitions.columns)


def expire_partitions(
    partitions: DataFrame,
    as_of: datetime | date | str,
    retention_days: int | dict[str, int],
    dataset: str | None = None,
) -> DataFrame:
    """Keep or expire each dt partition; the cutoff day itself is kept.

    Either ``dataset`` names the one all rows belong to, or the rows carry a
    `dataset` column and ``retention_days`` maps each to its days.
    """
    today = F.lit(as_day(as_of))
    cutoff = F.date_sub(today, _per_dataset(retention_days, 0))
    day = F.to_date(F.try_to_timestamp(F.col("dt"), F.lit("yyyy-MM-dd")))
    dated = _labelled(partitions, dataset).withColumn("_day", day).filter(F.col("_day").isNotNull())
    expired = F.col("_day") < cutoff
    return dated.select(
        *[c for c in dated.columns if c != "_day"],
        F.datediff(today, F.col("_day")).cast("bigint").alias("age_days"),
        F.date_format(cutoff, "yyyy-MM-dd").alias("cutoff"),
        F.when(expired, "expire").otherwise("keep").alias("action"),
    )


def expire_objects(
    objects: DataFrame,
    as_of: datetime | str,
    retention_days: int,
    dataset: str,
    written_at: str = "written_at",
) -> DataFrame:
    """Keep or expire each object by its last write; the cutoff instant is kept."""
    stamp = as_of if isinstance(as_of, datetime) else parse_instant(as_of)
    now = F.to_timestamp(F.lit(stamp.isoformat()))
    cutoff = now - F.expr(f"INTERVAL '{max(int(retention_days), 0)}' DAY")
    return objects.filter(F.col(written_at).isNotNull()).select(
        F.lit(dataset).alias("dataset"),
        *objects.columns,
        age_days(now, F.col(written_at)).alias("age_days"),
        F.when(F.col(written_at) < cutoff, "expire").otherwise("keep").alias("action"),
    )


def compact_plan(
    partitions: DataFrame, max_objects: int | dict[str, int], dataset: str | None = None
) -> DataFrame:
    """Compact partitions holding more than ``max_objects``; equality keeps."""
    budget = _per_dataset(max_objects, 1).cast("bigint")
    return _labelled(partitions, dataset).select(
        "*",
        budget.alias("max_objects"),
        F.when(F.col("objects") > budget, "compact").otherwise("keep").alias("action"),
    )


def zone_plan(
    partitions: DataFrame,
    as_of: datetime | date | str,
    retention_days: int | dict[str, int],
    max_objects: int | dict[str, int],
    dataset: str | None = None,
) -> DataFrame:
    """Expire first, then compact what remains, as one action per partition.

    Partitions without a day never expire here; their objects expire by age.
    """
    rows = _labelled(partitions, dataset)
    day = F.lit(None).cast("date")
    if "dt" in rows.columns:
        day = F.to_date(F.try_to_timestamp(F.col("dt"), F.lit("yyyy-MM-dd")))
    cutoff = F.date_sub(F.lit(as_day(as_of)), _per_dataset(retention_days, 0))
    crowded = F.col("objects") > _per_dataset(max_objects, 1)
    return rows.withColumn(
        "action", F.when(day < cutoff, "expire").when(crowded, "compact").otherwise("keep")
    )


def plan_counts(plan: DataFrame) -> DataFrame:
    """Expire and compact counters of a plan, per dataset."""
    return plan.groupBy("dataset").agg(
        F.count_if(F.col("action") == "expire").alias("expire_count"),
        F.count_if(F.col("action") == "compact").alias("compact_count"),
    )
