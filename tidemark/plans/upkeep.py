"""Carrying out maintenance plans on stored zones."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.operators import maintenance as M
from tidemark.operators.partitions import objects_per_partition
from tidemark.schemas import MAINTENANCE_POLICY
from tidemark.session import materialize, scratch_path
from tidemark.sources.objects import inventory
from tidemark.sources.sinks import only_partitions, write_partitions
from tidemark.sources.storage import delete_paths, exists, remove, swap_folders


def partition_plan(
    spark: SparkSession,
    location: str,
    dataset: str,
    as_of: datetime | str,
    retention_days: int | None = None,
    max_objects: int | None = None,
) -> DataFrame:
    """Planned action of every stored partition, from a listing alone."""
    _, columns, days, objects = MAINTENANCE_POLICY[dataset]
    required = tuple(c for c in columns if c == "dt") or columns
    present = objects_per_partition(inventory(spark, location), columns, required)
    days = days if retention_days is None else retention_days
    return M.zone_plan(present, as_of, days, objects if max_objects is None else max_objects, dataset)


def expire(
    spark: SparkSession, location: str, plan: DataFrame, table: str | None = None, record: str | None = None
) -> DataFrame:
    """Delete the folders of partitions planned to expire; one row of counters.

    With a ``record`` folder of an earlier call that died, the rest of its list is deleted.
    """
    columns = [c for c in plan.columns if c in ("event_type", "metric", "reason", "dt")]
    gone = plan.filter(F.col("action") == "expire").select(*columns)
    folders = _folders(spark, location, columns).join(gone, columns, "left_semi")
    result = materialize(delete_paths(folders, record or scratch_path(spark, "expire")), "expired")
    spark.catalog.refreshByPath(location)
    if table:
        spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")
    return result


def layout(spark: SparkSession, location: str) -> list[str]:
    """Names of the partition columns in the folders of a table, outer first."""
    path = inventory(spark, location).select("path").first()
    below = "" if path is None else path["path"].partition(location.split(":", 1)[-1].strip("/"))[2]
    return re.findall(r"/([^/=]+)=[^/]*(?=/)", below)


def _folders(spark: SparkSession, location: str, columns: list[str]) -> DataFrame:
    """Partition folders that hold objects, with their partition values."""
    objects = inventory(spark, location)
    return objects.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("path"), *[K.hive_value(F.col("path"), c).alias(c) for c in columns]
    ).distinct()


def expire_objects(
    spark: SparkSession,
    location: str,
    dataset: str,
    as_of: datetime | str,
    retention_days: int | None = None,
    record: str | None = None,
) -> DataFrame:
    """Delete single objects last written before the cutoff; one row of counters."""
    days = MAINTENANCE_POLICY[dataset][2] if retention_days is None else retention_days
    objects = inventory(spark, location).withColumnRenamed("modificationTime", "written_at")
    plan = M.expire_objects(objects, as_of, days, dataset)
    gone = plan.filter(F.col("action") == "expire")
    result = materialize(delete_paths(gone, record or scratch_path(spark, "expire")), "expired")
    spark.catalog.refreshByPath(location)
    return result


def compact(
    spark: SparkSession,
    location: str,
    plan: DataFrame,
    interrupt: Callable[[str], None] | None = None,
) -> DataFrame:
    """Rewrite planned partitions into few objects, row for row; returns those partitions.

    A partition of the plan may be spread over folders of further columns, such as runs;
    each of them is rewritten for itself.

    The rows are staged under `_compact` in the table, a name that readers pass over.
    When every staged folder has as many rows as the stored one, the folders are
    swapped by the recorded steps of `swap_folders`. What an earlier call left half done
    is completed first. ``interrupt(step)`` is called behind staging.
    """
    location = location.rstrip("/")
    columns = [c for c in plan.columns if c in ("event_type", "metric", "reason", "dt")]
    finish_compaction(spark, location)
    chosen = materialize(plan.filter(F.col("action") == "compact").select(*columns), "compact-plan")
    if chosen.isEmpty():
        return chosen
    work = f"{location}/_compact"
    stored, folders = spark.read.parquet(location), layout(spark, location)
    rows = only_partitions(stored, chosen, tuple(columns))
    write_partitions(rows, f"{work}/staged", tuple(folders))
    kept, made = (frame.groupBy(*folders).count() for frame in (rows, spark.read.schema(stored.schema).parquet(f"{work}/staged")))
    lost = kept.exceptAll(made).limit(1).count() + made.exceptAll(kept).limit(1).count()
    if lost:
        remove(spark, work)
        raise RuntimeError(f"compaction of {location} would lose or repeat rows; nothing was changed")
    pairs = _folders(spark, f"{work}/staged", folders).select(
        F.col("path").alias("staged"),
        F.replace("path", F.lit("/_compact/staged/"), F.lit("/")).alias("live"),
        F.replace("path", F.lit("/_compact/staged/"), F.lit("/_compact/aside/")).alias("aside"),
    )
    pairs.write.mode("overwrite").parquet(f"{work}/record/swaps")
    if interrupt:
        interrupt("staged")
    finish_compaction(spark, location)
    return chosen


def finish_compaction(spark: SparkSession, location: str) -> int:
    """Complete the recorded swaps of a compaction, or drop one that was not recorded yet; folders swapped."""
    work = f"{location.rstrip('/')}/_compact"
    swapped = 0
    if exists(spark, f"{work}/record/swaps/_SUCCESS"):
        swapped = swap_folders(spark, f"{work}/record")
    remove(spark, work)
    spark.catalog.refreshByPath(location)
    return swapped


def maintain(
    spark: SparkSession,
    location: str,
    dataset: str,
    as_of: datetime | str,
    apply: bool = False,
    retention_days: int | None = None,
    max_objects: int | None = None,
) -> DataFrame:
    """Expire, then compact what is left. One row of counters; a dry run by default."""
    plan = materialize(partition_plan(spark, location, dataset, as_of, retention_days, max_objects), "plan")
    by_age = "dt" not in MAINTENANCE_POLICY[dataset][1]
    expired, deleted = None, 0
    if by_age:
        days = MAINTENANCE_POLICY[dataset][2] if retention_days is None else retention_days
        objects = inventory(spark, location).withColumnRenamed("modificationTime", "written_at")
        expired = M.expire_objects(objects, as_of, days, dataset).filter(F.col("action") == "expire").count()
    if apply:
        done = expire_objects(spark, location, dataset, as_of, retention_days) if by_age else expire(spark, location, plan)
        deleted = done.first()["deleted"]
        if by_age:
            plan = materialize(partition_plan(spark, location, dataset, as_of, retention_days, max_objects), "plan")
        compact(spark, location, plan)
    return plan.agg(
        F.lit(dataset).alias("dataset"),
        (F.count_if(F.col("action") == "expire") if expired is None else F.lit(expired)).cast("bigint").alias("expire_count"),
        F.count_if(F.col("action") == "compact").alias("compact_count"),
        F.lit(deleted).cast("bigint").alias("deleted_count"),
        F.lit(apply).alias("applied"),
    )


def maintain_platform(
    spark: SparkSession,
    root: str,
    as_of: datetime | str,
    apply: bool = False,
    retention_days: dict[str, int] | None = None,
    max_objects: dict[str, int] | None = None,
) -> DataFrame:
    """All five datasets in policy order; zones that hold nothing are skipped."""
    reports = [
        maintain(spark, f"{root}/{folder}", dataset, as_of, apply, (retention_days or {}).get(dataset), (max_objects or {}).get(dataset))
        for dataset, (folder, *_rest) in MAINTENANCE_POLICY.items()
        if exists(spark, f"{root}/{folder}")
    ]
    return reduce(DataFrame.unionByName, reports)


def zone_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, records, crowded): rows of each stored zone, and its folders with more than one object."""
    found = []
    for dataset, (folder, *_rest) in MAINTENANCE_POLICY.items():
        location = f"{root}/{folder}"
        if not exists(spark, location):
            continue
        per_folder = inventory(spark, location).groupBy(F.regexp_replace("path", "/[^/]*$", "")).agg(F.count(F.lit(1)).alias("n"))
        crowded = per_folder.agg(F.count_if(F.col("n") > 1).alias("crowded"))
        rows = spark.read.parquet(location).agg(F.count(F.lit(1)).alias("records"))
        found.append(rows.select(F.lit(dataset).alias("dataset"), "records", crowded.scalar().alias("crowded")))
    return reduce(DataFrame.unionByName, found)


def platform_totals(reports: DataFrame) -> DataFrame:
    names = ("expire_count", "compact_count", "deleted_count")
    return reports.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
