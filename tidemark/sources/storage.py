"""Deleting and moving stored folders through Spark's own file systems.

Every step is one call of the file system that Spark reads the path with, so it works
wherever the tables do. Work is recorded before it is begun: a job that died goes on with
what its record lists, and finds steps already taken.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "path STRING, deleted BOOLEAN, error STRING"
#: Calls under way at a time, and results kept in memory before they are recorded.
CALLS, CHUNK = 16, 1024


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _located(spark, path)
    return system.exists(place)


def make_folder(spark: SparkSession, path: str) -> None:
    system, place = _located(spark, path)
    system.mkdirs(place)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete an object or a whole folder; one that is gone counts as deleted."""
    system, place = _located(spark, path)
    return system.delete(place, True) or not system.exists(place)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; the folders above the target are made."""
    system, place = _located(spark, source)
    goal = spark._jvm.org.apache.hadoop.fs.Path(target)
    system.mkdirs(goal.getParent())
    if not system.rename(place, goal):
        raise OSError(f"cannot move {source} to {target}")


def in_parallel(work, items: Iterable) -> Iterator:
    """Results of file system calls, a bounded number of them under way."""
    items = iter(items)
    with ThreadPoolExecutor(CALLS) as pool:
        while chunk := list(islice(items, CHUNK)):
            yield list(pool.map(work, chunk))


def delete_paths(paths: DataFrame, record: str) -> DataFrame:
    """Delete each path (object or folder); one row of counters.

    ``record`` is a folder: `planned` lists the paths and is written once, `done` grows by
    the results. Called again with the same record, only what is not done is deleted, whatever
    the frame now lists. Counters: planned, deleted, failed, first_error.
    """
    spark = paths.sparkSession
    if not exists(spark, f"{record}/planned/_SUCCESS"):
        paths.select("path").distinct().write.mode("overwrite").parquet(f"{record}/planned")
    planned = spark.read.schema("path STRING").parquet(f"{record}/planned")
    make_folder(spark, f"{record}/done")
    done = spark.read.schema(RESULT).parquet(f"{record}/done")
    left = planned.join(done.filter("deleted"), "path", "left_anti")

    def delete(row) -> tuple[str, bool, str | None]:
        try:
            gone = remove(spark, row["path"])
            return (row["path"], gone, None if gone else "not deleted")
        except Exception as error:  # the file system's answer goes into the record
            return (row["path"], False, str(error).splitlines()[0][:500])

    for results in in_parallel(delete, left.toLocalIterator()):
        spark.createDataFrame(results, RESULT).coalesce(1).write.mode("append").parquet(f"{record}/done")
    results = spark.read.schema(RESULT).parquet(f"{record}/done")
    latest = results.groupBy("path").agg(F.max("deleted").alias("deleted"), F.min("error").alias("error"))
    return latest.agg(
        F.lit(planned.count()).alias("planned"),
        F.count_if("deleted").alias("deleted"),
        F.count_if(~F.col("deleted")).alias("failed"),
        F.min(F.when(~F.col("deleted"), F.col("error"))).alias("first_error"),
    )


def swap_folders(spark: SparkSession, record: str) -> int:
    """Put staged folders in the place of live ones; returns how many.

    ``record`` holds the table `swaps` of (staged, live, aside). The live folder is moved aside, then the staged
    one into its place; both steps show in which of the three folders exist, so a restart
    over the recorded pairs completes a swap at either step. Folders set aside are deleted
    only when every swap is complete.
    """
    recorded = spark.read.schema("staged STRING, live STRING, aside STRING").parquet(f"{record}/swaps")

    def swap(row) -> bool:
        if exists(spark, row["staged"]):
            if not exists(spark, row["aside"]) and exists(spark, row["live"]):
                move(spark, row["live"], row["aside"])
            move(spark, row["staged"], row["live"])
        return True

    swapped = sum(sum(chunk) for chunk in in_parallel(swap, recorded.toLocalIterator()))
    for _ in in_parallel(lambda row: remove(spark, row["aside"]), recorded.toLocalIterator()):
        pass
    return swapped


def undo_swaps(spark: SparkSession, record: str) -> int:
    """Bring back the live folders of swaps that are not complete; returns how many."""
    recorded = spark.read.schema("staged STRING, live STRING, aside STRING").parquet(f"{record}/swaps")

    def restore(row) -> bool:
        half = exists(spark, row["staged"]) and exists(spark, row["aside"]) and not exists(spark, row["live"])
        if half:
            move(spark, row["aside"], row["live"])
        return half

    return sum(sum(chunk) for chunk in in_parallel(restore, recorded.toLocalIterator()))
