"""Run records: build, complete, read back, metric points."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.counters import estimated_bytes, first_counter, numeric_counter
from tidemark.operators.identity import last_write
from tidemark.schemas import METRIC_UNITS, QUALITY_RESULT, RUN_SCHEMA, RUN_STATUSES, RUN_STEPS, RUN_ZONES


def run_record(
    spark: SparkSession,
    run_id: str,
    status: str,
    started_at: datetime,
    zone: str | None = None,
    step: str | None = None,
    finished_at: datetime | None = None,
    parent_run_id: str | None = None,
    error: str | None = None,
    object_count: int = 0,
    objects: str | None = None,
    quality: str | None = None,
    metrics: str | None = None,
) -> DataFrame:
    """One run version as a one-row frame; JSON texts for nested parts."""
    if status not in RUN_STATUSES:
        raise ValueError(f"unknown run status {status!r}")
    row = (
        run_id, status, started_at, finished_at, zone if zone in RUN_ZONES else None,
        step if step in RUN_STEPS else None, parent_run_id, error, object_count, objects, quality, metrics,
    )
    return spark.createDataFrame([row], RUN_SCHEMA)


def complete(
    runs: DataFrame,
    status: Column | str,
    finished_at: datetime | Column | None = None,
    error: Column | str | None = None,
    metrics: Column | None = None,
) -> DataFrame:
    """Next version of open runs: status, finish time, merged counters."""
    done = finished_at if finished_at is not None else datetime.now(tz=timezone.utc)
    result = runs.withColumns(
        {
            "status": status if isinstance(status, Column) else F.lit(status),
            "finished_at": done if isinstance(done, Column) else F.lit(done),
            "error": error if isinstance(error, Column) else F.lit(error).cast("string"),
        }
    )
    if metrics is None:
        return result
    old = F.from_json(F.coalesce("metrics", F.lit("{}")), "map<string,string>")
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(metrics), k))
    return result.withColumn("metrics", F.to_json(F.map_concat(kept, metrics)))


def step_outcome(found: Column, missing: Column, passed: Column | None = None, action: Column | None = None) -> Column:
    """failed when every input was missing, quality_failed on a failing gate."""
    outcome = F.when((missing > 0) & (found == 0), "failed")
    if passed is not None:
        outcome = outcome.when(~passed & (action == "fail"), "quality_failed")
    return outcome.otherwise("succeeded")


def latest_versions(log: DataFrame, order: tuple[str, ...] = ("started_at",)) -> DataFrame:
    """Newest version of each run of an append-only run log."""
    return last_write(log, ("run_id",), order)


def latest_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs; ties in start time are ordered by run id."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id")).limit(limit)


def find_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def counters(runs: DataFrame) -> DataFrame:
    """Long form of the counters: one row per run and counter name."""
    pairs = F.explode(F.from_json("metrics", "map<string,string>")).alias("name", "value")
    return runs.filter(F.col("metrics").isNotNull()).select("run_id", pairs)


def decode(runs: DataFrame) -> DataFrame:
    """Run records with nested parts as types; unreadable JSON reads as empty."""
    return runs.withColumns(
        {
            "objects": F.coalesce(F.from_json("objects", "array<string>"), F.array().cast("array<string>")),
            "quality": F.coalesce(
                F.from_json("quality", f"array<{QUALITY_RESULT.simpleString()}>"),
                F.array().cast(f"array<{QUALITY_RESULT.simpleString()}>"),
            ),
            "metrics": F.from_json(F.coalesce("metrics", F.lit("{}")), "map<string,string>"),
        }
    )


def metric_points(runs: DataFrame) -> DataFrame:
    """Metric points of each run.

    ``runs`` has zone, status, started_at, finished_at, latest_event_ts and the
    counters as JSON text `metrics`. Names are emitted by zone and by counter,
    one pass per run.
    """
    m = F.col("_m")
    frame = runs.withColumn("_m", F.try_parse_json(F.coalesce("metrics", F.lit("{}"))))
    frame = frame.withColumns(
        {
            "_records": first_counter(m, "valid", "rows_scanned", "silver_read", "object_count", "records"),
            "_failed": first_counter(m, "rows_failed", "quarantined"),
            "_scanned": first_counter(m, "rows_scanned", "valid"),
            "_late": first_counter(m, "late"),
            "_written": first_counter(m, "gold_written", "silver_written", "metrics_written", "objects_written"),
            "_ratio": numeric_counter(m, "fail_ratio"),
        }
    )
    zone = F.col("zone")
    share = F.when(F.col("_scanned") == 0, F.lit(0.0)).otherwise(F.col("_failed") / F.col("_scanned"))
    duration = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000.0
    lag = (F.unix_micros("finished_at") - F.unix_micros("latest_event_ts")) / 1000000.0
    gold_objects = F.when(zone == "gold", F.col("_written")).otherwise(F.lit(0).cast("bigint"))
    values = {
        "RecordsProcessed": F.col("_records"),
        "QualityFailures": F.when(zone.isin("quality", "silver") | (F.col("_failed") != 0), F.col("_failed")),
        "QualityFailRatio": F.when(
            (zone == "quality") & (F.col("_scanned") >= 0), F.coalesce(F.col("_ratio"), share)
        ),
        "LateEvents": F.when((zone == "silver") | (F.col("_late") != 0), F.col("_late")),
        "ObjectsWritten": F.col("_written"),
        "EstimatedBytes": estimated_bytes(F.col("_records"), gold_objects),
        "RunDurationMilliseconds": F.greatest(F.lit(0.0), duration),
        "PipelineLagSeconds": F.when(F.col("latest_event_ts").isNotNull(), F.greatest(F.lit(0.0), lag)),
    }
    values["RunDurationMilliseconds"] = F.when(F.col("started_at").isNotNull(), values["RunDurationMilliseconds"])
    points = F.array(
        *[
            F.when(
                value.isNotNull(),
                F.struct(
                    F.lit(name).alias("name"),
                    value.cast("double").alias("value"),
                    F.lit(METRIC_UNITS[name]).alias("unit"),
                ),
            )
            for name, value in values.items()
        ]
    )
    return frame.select(
        "run_id",
        "zone",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.col("finished_at").alias("timestamp"),
        F.inline(F.filter(points, lambda p: p.isNotNull())),
    )
