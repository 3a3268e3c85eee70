"""Object inventories, tolerant JSON reads, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Path, last write and size of every object below a prefix; no content is read.

    Objects deleted after the listing are skipped when the frame is evaluated.
    Spark's file sources pass over objects of zero bytes.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select("path", "modificationTime", "length")


def read_json_objects(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """One row per stored object: whole text `raw`, `source_key`, `landed_at`.

    Objects that vanish between listing and reading are skipped.
    """
    reader = (
        spark.read.format("text")
        .option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .option("pathGlobFilter", pattern)
    )
    return reader.load(root).select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("source_key"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
    )


def read_json_lines(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """One row per line of newline-delimited JSON files."""
    reader = spark.read.format("text").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    return reader.option("pathGlobFilter", pattern).load(root).select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("source_key"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
    )


def split_scope(refs: DataFrame, prefix: str = "events/", key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Keys of a trigger inside the prefix, and those outside it."""
    inside = F.col(key).startswith(prefix)
    return refs.filter(inside), refs.filter(~inside)


def found(manifest: DataFrame, present: DataFrame, key: str = "key") -> DataFrame:
    """Manifest entries that exist in the inventory."""
    return manifest.join(present.select(key).distinct(), key, "left_semi")


def missing(manifest: DataFrame, present: DataFrame, key: str = "key") -> DataFrame:
    """Manifest entries with no object behind them."""
    return manifest.join(present.select(key), key, "left_anti")


def select_scope(refs: DataFrame, everything: DataFrame, prefix: str = "events/", key: str = "key") -> DataFrame:
    """The trigger's keys, or the whole prefix when the trigger names none."""
    named, _ = split_scope(refs, prefix, key)
    if refs.isEmpty():
        return everything.filter(F.col(key).startswith(prefix)).select(key)
    return named.select(key)


def arrivals(refs: DataFrame, present: DataFrame, prefix: str = "events/") -> DataFrame:
    """Each referenced key labelled accepted, skipped (outside) or missing."""
    keys = present.select(F.col("key")).distinct().withColumn("_present", F.lit(True))
    return (
        refs.join(keys, "key", "left")
        .withColumn(
            "outcome",
            F.when(~F.col("key").startswith(prefix), "skipped")
            .when(F.col("_present"), "accepted")
            .otherwise("missing"),
        )
        .drop("_present")
    )
