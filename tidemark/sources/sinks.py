"""Zone writers. All keep every row and are safe to repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.operators.gold import accepted_metrics, rejected_metrics, serving_rows, with_metric_faults
from tidemark.operators.identity import SILVER_IDENTITY, last_write
from tidemark.schemas import GOLD_SCHEMA, RUN_SCHEMA, SILVER_SCHEMA
from tidemark.session import materialize
from tidemark.sources.storage import exists, remove


def write_partitions(df: DataFrame, path: str, columns: tuple[str, ...], rebalance: bool = True) -> None:
    """Replace the partitions present in the frame, leave the others.

    The rebalance step gathers each partition's rows into few files, splits a
    partition that is far larger than the rest over several tasks, and joins
    small ones, all from the sizes seen at run time.
    """
    frame = df.hint("rebalance", *columns) if rebalance else df
    (
        frame.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(path)
    )


def append_partitions(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    df.hint("rebalance", *columns).write.mode("append").partitionBy(*columns).parquet(path)


def write_bronze(bronze: DataFrame, path: str, format: str = "parquet", batch: str | None = None) -> None:
    """Raw text by day. With format 'text', newline-delimited JSON.

    A named batch replaces itself, so a retry adds nothing; without a name rows are appended.
    """
    columns = ("dt",) if batch is None else ("dt", "batch")
    rows = bronze if batch is None else bronze.withColumn("batch", F.lit(batch))
    if format == "text":
        rows = rows.select("raw", *columns)
    writer = rows.hint("rebalance", *columns).write.format(format).partitionBy(*columns)
    if batch is None:
        writer.mode("append").save(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)


def write_silver(accepted: DataFrame, path: str, order: tuple[str, ...] = ("landed_at",)) -> None:
    """Conformed events by type and day, the last write of an event kept.

    The frame must hold the whole of each partition it touches, as a run over all
    of Bronze does. For a partial batch use `upsert_silver`.
    """
    rows = accepted.select(*SILVER_SCHEMA.names)
    write_partitions(last_write(rows, SILVER_IDENTITY, order), path, ("event_type", "dt"))


def only_partitions(stored: DataFrame, wanted: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of the listed partitions of a stored table.

    The bounds of each partition column, one row whatever the list's length, become
    literal filters that prune before any file is opened; the join makes it exact.
    """
    bounds = wanted.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]).first()
    for name in columns:
        stored = stored.filter(F.col(name).between(bounds[f"low_{name}"], bounds[f"high_{name}"]))
    return stored.join(wanted.select(*columns).distinct(), list(columns), "left_semi")


def upsert_silver(accepted: DataFrame, path: str, order: tuple[str, ...] = ("landed_at",)) -> DataFrame:
    """Merge a partial batch into the partitions it touches; returns these partitions.

    Only those partitions are read and replaced. The merged rows are staged
    first, so the table is never read while it is being replaced.
    """
    spark = accepted.sparkSession
    columns = ("event_type", "dt")
    batch = materialize(accepted.select(*SILVER_SCHEMA.names), "silver-batch")
    touched = materialize(batch.select(*columns).distinct(), "silver-touched")
    rows = batch
    if is_stored(spark, path):
        rows = only_partitions(read_silver(spark, path), touched, columns).select(*SILVER_SCHEMA.names).unionByName(batch)
    merged = last_write(rows, SILVER_IDENTITY, order)
    write_partitions(materialize(merged, "silver-merge"), path, columns)
    return touched


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there."""
    return exists(spark, path)


def replace_run(
    rows: DataFrame, path: str, run_id: str, columns: tuple[str, ...], format: str = "parquet", empty: bool | None = None
) -> None:
    """Rows of one run by further columns. A repeated run replaces all it wrote before, with nothing too."""
    folder = f"{path}/run_id={run_id}"
    if rows.isEmpty() if empty is None else empty:
        remove(rows.sparkSession, folder)
        return
    writer = rows.hint("rebalance", *columns).write if format == "parquet" else rows.coalesce(1).write
    writer.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*columns).format(format).save(folder)


def quarantine_rows(quarantined: DataFrame) -> DataFrame:
    """Rejected rows for storage: reason, the raw text, failed checks."""
    kept = [c for c in ("source_key", "landed_at") if c in quarantined.columns]
    return quarantined.select(
        F.coalesce("event_id", F.lit("unknown")).alias("event_id"),
        F.col("raw").alias("payload"),
        "checks",
        *kept,
        K.path_safe(F.col("reason")).alias("reason"),
    )


def write_silver_quarantine(quarantined: DataFrame, path: str, run_id: str) -> None:
    """Rejected rows by run and reason."""
    replace_run(quarantine_rows(quarantined), path, run_id, ("reason",))


def write_gold(gold: DataFrame, path: str) -> None:
    """Metric rows by metric and day; only the days present are replaced."""
    rows = serving_rows(gold).withColumnRenamed("event_type", "metric")
    write_partitions(rows.select("metric_day", "events", "amount_usd", "metric", "dt"), path, ("metric", "dt"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD_SCHEMA).parquet(path)


def sample_gold(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """A page of the keyed Gold copy."""
    return read_gold(spark, path).orderBy("metric_day").limit(limit)


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SILVER_SCHEMA).parquet(path)


GOLD_REJECTS = "payload STRING, zone STRING, run_id STRING, reason STRING, metric STRING, dt STRING"


def write_gold_quarantine(rows: DataFrame, path: str, run_id: str, empty: bool | None = None) -> None:
    """Rejected metric rows by run, reason, metric and day."""
    replace_run(rows, path, run_id, ("reason", "metric", "dt"), empty=empty)


def read_gold_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD_REJECTS).parquet(path)


def publish_metrics(metrics: DataFrame, root: str, run_id: str) -> tuple[int, int]:
    """Split daily metrics by the Gold contract, write both sides; rows accepted and rejected."""
    checked = materialize(with_metric_faults(metrics), "gold")
    good, bad = accepted_metrics(checked), rejected_metrics(checked)
    write_gold(good, f"{root}/gold/metrics")
    rejects = bad.select(
        F.to_json(F.struct("dt", "event_type", "events", "amount_usd")).alias("payload"),
        F.lit("gold").alias("zone"),
        "reason",
        K.or_unknown(F.col("event_type")).alias("metric"),
        K.or_unknown(F.col("dt")).alias("dt"),
    )
    sides = checked.agg(F.count_if(F.size("reasons") == 0).alias("good"), F.count_if(F.size("reasons") > 0).alias("bad")).first()
    write_gold_quarantine(rejects, f"{root}/gold/quarantine", run_id, empty=not sides["bad"])
    return sides["good"], sides["bad"]


def write_report(report: DataFrame, path: str, day: str) -> None:
    """The one-row report of a run as JSON, with its day; a run repeated on another day replaces its own."""
    rows = report.drop("run_id").withColumn("dt", F.lit(day))
    replace_run(rows, path, report.first()["run_id"], ("dt",), "json")


def recent_reports(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The newest reports by day and file name."""
    schema = (
        "run_id STRING, passed BOOLEAN, action STRING, rows_scanned BIGINT, rows_failed BIGINT, fail_ratio DOUBLE, "
        "checks ARRAY<STRUCT<check_name: STRING, passed: BOOLEAN, rows_scanned: BIGINT, rows_failed: BIGINT, "
        "detail: STRING>>, dt STRING"
    )
    reports = spark.read.schema(schema).json(path)
    keyed = reports.withColumn("report_key", F.col("_metadata.file_path"))
    return keyed.orderBy(F.col("dt").desc(), F.col("report_key").desc()).limit(limit)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)
