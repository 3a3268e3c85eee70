"""Streaming jobs: delivery to Bronze, cleansing to Silver, upkeep of Gold.

Delivery is at least once. Every sink is keyed by the batch id or rebuilt from
its source, so a repeated batch leaves the same tables behind.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import keys as K
from tidemark.operators import cleanse as C
from tidemark.operators.gold import daily_metrics
from tidemark.operators.identity import SILVER_IDENTITY, last_write, manifest_identity
from tidemark.operators.runs import run_record
from tidemark.schemas import DEFAULT_LOOKBACK_DAYS, SILVER_SCHEMA
from tidemark.session import materialize, scratch_path, settings
from tidemark.sources import deadletter, sinks
from tidemark.sources.notifications import extract_refs, undecodable
from tidemark.sources.objects import inventory
from tidemark.sources.storage import delete_paths, make_folder
from tidemark.streaming.current import CHANGES, STATE_CONF, changes, metrics_of
from tidemark.streaming.records import RECORD_SCHEMA, decode

FILES_PER_BATCH = 10
#: Queue files that each core gets in a batch.
QUEUE_FILES_PER_CORE = 8
#: Messages that are handled together, the delivery unit of a queue.
MESSAGES = 10


def record_stream(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Bronze rows from a folder of records, a few files per batch."""
    records = spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
    text = decode(F.col("data"))
    day = F.substring(F.get_json_object(text, "$.event_ts"), 1, 10)
    return records.select(
        text.alias("raw"),
        F.col("_metadata.file_path").alias("source_key"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
        K.or_unknown(day).alias("dt"),
    )


def message_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Queue messages, one text line each, numbered within their file.

    Ten messages at a time are one `invocation` (source_key and number), whatever the
    number of files; a micro-batch runs many of them side by side. A file is read whole,
    so those who fill the queue bound its messages, as with `maxRecordsPerFile`. A file is
    one task, so a batch takes as many as keep all cores busy, unless told otherwise.
    """
    if files_per_batch is None:
        files_per_batch = max(FILES_PER_BATCH, QUEUE_FILES_PER_CORE * spark.sparkContext.defaultParallelism)
    reader = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch)
    files = reader.load(path).select(
        F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("position", "raw"),
        F.col("_metadata.file_path").alias("source_key"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
    )
    return files.withColumn("invocation", F.floor(F.col("position") / MESSAGES).cast("bigint"))


def _start(writer, trigger: dict) -> StreamingQuery:
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def deliver_bronze(bronze: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Land raw rows by day; the file sink commits each batch once.

    Production use buffers with ``trigger={"processingTime": "60 seconds"}``.
    """
    writer = bronze.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return _start(writer.partitionBy("dt"), trigger)


def drain_messages(
    messages: DataFrame, refs_path: str, dlq_root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Flatten notifications; messages that cannot be decoded go to the dead letters.

    One that fails keeps no other of its invocation back. The counts of every invocation
    are stored beside the references, in `<refs_path>-invocations`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            refs = extract_refs(batch).withColumn("batch", F.lit(batch_id))
            sinks.write_partitions(refs, refs_path, ("batch",), rebalance=False)
            failed = undecodable(batch, keep=("source_key", "landed_at", "invocation", "position"))
            poison = failed.select(
                F.sha2(F.concat_ws("|", "source_key", "position", "raw"), 256).alias("message_id"),
                F.col("raw").alias("body"),
                F.lit(1).cast("bigint").alias("receive_count"),
                F.col("landed_at").alias("enqueued_at"),
            )
            deadletter.append(poison, dlq_root, f"stream-{batch_id}")
            unit = ("source_key", "invocation")
            sizes = batch.groupBy(*unit).agg(F.count(F.lit(1)).alias("messages"))
            lost = failed.groupBy(*unit).agg(F.count(F.lit(1)).alias("failed"))
            counts = sizes.join(lost, list(unit), "left").select(*unit, "messages", F.coalesce("failed", F.lit(0)).alias("failed"))
            folder = f"{refs_path.rstrip('/')}-invocations/batch={batch_id}"
            counts.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
        finally:
            batch.unpersist()

    return _start(messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), trigger)


@dataclass
class Streams:
    """Queries of a pipeline. With ``availableNow`` each starts when the one before it is done."""

    starts: list[Callable[[], StreamingQuery]]
    at_once: bool
    running: list[StreamingQuery] = field(default_factory=list)

    def start(self) -> Streams:
        for start in self.starts if self.at_once else self.starts[:1]:
            self.running.append(start())
        return self

    def awaitTermination(self) -> None:
        self.running[0].awaitTermination()
        for at, start in enumerate(self.starts[1:], 1):
            if at == len(self.running):
                self.running.append(start())
            self.running[at].awaitTermination()


def medallion(
    bronze: DataFrame,
    root: str,
    checkpoint: str,
    watermark: datetime | str | None = None,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    gold: bool = True,
    trigger: dict | None = None,
) -> Streams:
    """Cleanse each arriving batch into Silver and quarantine, and keep Gold from what Silver stores."""
    spark = bronze.sparkSession
    starts = [lambda: silver_stream(bronze, root, f"{checkpoint}/silver", watermark, lookback_days, trigger)]
    if gold:
        starts.append(lambda: gold_stream(spark, root, f"{checkpoint}/gold", trigger=trigger))
    return Streams(starts, at_once=bool(trigger) and "availableNow" not in trigger).start()


def silver_stream(
    bronze: DataFrame,
    root: str,
    checkpoint: str,
    watermark: datetime | str | None = None,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    trigger: dict | None = None,
    interrupt: Callable[[int, str], None] | None = None,
) -> StreamingQuery:
    """Silver and quarantine of each arriving batch, done once whatever is delivered again.

    The run log is the ledger of batches. A batch is known by the keys it holds: one that
    succeeded is left alone, under a new checkpoint too. One that was begun keeps its
    number, and so replaces in both tables what its first attempt wrote; any other gets
    the next number. ``interrupt(number, step)`` is called behind each step.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        started = datetime.now(tz=timezone.utc)
        spark = batch.sparkSession
        # By the keys alone: a batch that is left alone is not parsed.
        identity = manifest_identity(batch, (), "source_key", "silver").first()
        if not identity["parts"]:
            return
        run_id = identity["run_id"]
        status, number = _entry(spark, f"{root}/runs", run_id)
        if status == "succeeded":
            return
        rows = _judged(batch, watermark, lookback_days).persist()
        try:

            def log(status: str, finished: datetime | None = None, **counts: int) -> None:
                metrics = json.dumps({"batch": number, **counts})
                record = run_record(
                    spark, run_id, status, started, "silver", "silver", finished, object_count=identity["parts"], metrics=metrics
                )
                sinks.append_runs(record, f"{root}/runs")

            log("running")
            numbered = rows.withColumn("batch", F.lit(number).cast("bigint"))
            good = last_write(C.accepted(numbered).select(*SILVER_SCHEMA.names, "batch"), SILVER_IDENTITY, ("landed_at",))
            sinks.write_partitions(good, f"{root}/silver/events", ("event_type", "dt", "batch"))
            if interrupt:
                interrupt(number, "silver")
            bad = sinks.quarantine_rows(C.quarantined(rows)).withColumn("batch", F.lit(number).cast("bigint"))
            sinks.write_partitions(bad, f"{root}/silver/quarantine", ("reason", "batch"))
            if interrupt:
                interrupt(number, "quarantine")
            counts = rows.agg(
                F.count_if(F.col("reason").isNull()).alias("valid"),
                F.count_if(F.col("reason").isNotNull()).alias("quarantined"),
                F.count_if("_late").alias("late"),
            ).first()
            log("succeeded", datetime.now(tz=timezone.utc), **counts.asDict())
        finally:
            rows.unpersist()

    return _start(bronze.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), trigger)


def _judged(batch: DataFrame, watermark: datetime | str | None, lookback_days: int) -> DataFrame:
    """The cleansed rows of a batch; the text is kept of those alone that go to the quarantine."""
    rows = C.cleanse(batch, watermark, lookback_days, gate=True)
    return rows.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))


def _entry(spark: SparkSession, path: str, run_id: str) -> tuple[str | None, int]:
    """Status of a batch in the run log, and its number: the one it has, or the next."""
    if not sinks.is_stored(spark, path):
        return None, 0
    own = F.col("run_id") == run_id
    number = F.get_json_object("metrics", "$.batch").try_cast("bigint")
    row = (
        sinks.read_runs(spark, path)
        .filter(F.col("step") == "silver")
        .agg(
            F.max(F.when(own, number)).alias("own"),
            F.bool_or(own & (F.col("status") == "succeeded")).alias("done"),
            F.max(number).alias("last"),
        )
        .first()
    )
    status = None if row["own"] is None else "succeeded" if row["done"] else "running"
    return status, row["own"] if row["own"] is not None else -1 if row["last"] is None else row["last"] + 1


def gold_stream(
    spark: SparkSession, root: str, checkpoint: str, files_per_batch: int | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Gold kept up to date from the Silver files as they are stored.

    The state and the partial sums both lie under the checkpoint: if it is lost, Gold is
    built again from all of Silver. A batch writes its partial sums, a row per type and day,
    by day and batch, reads those of the types and days it changed, splits the metrics by the contract and
    publishes both sides. Files that a repeated Silver batch has replaced meanwhile are
    passed over; the rows that replace them come as other files.
    """
    silver, partials = f"{root}/silver/events", f"{checkpoint}/partials"
    make_folder(spark, silver)
    source = spark.readStream.schema(_silver_ddl()).option("ignoreMissingFiles", "true")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)

    def write(changed: DataFrame, batch_id: int) -> None:
        started = datetime.now(tz=timezone.utc)
        session = changed.sparkSession
        sums = [F.sum(c).alias(c) for c in ("events", "added", "retracted", "fresh", "overwritten", "unchanged")]
        made = changed.groupBy("event_type", "dt").agg(*sums).withColumn("batch", F.lit(batch_id).cast("bigint"))
        made.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").parquet(partials)
        stored = session.read.schema(f"{CHANGES}, batch BIGINT").parquet(partials)
        own = stored.filter(F.col("batch") == F.lit(batch_id))
        counts = own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fresh", "overwritten", "unchanged")]).first()
        accepted = rejected = 0
        if counts["fresh"] or counts["overwritten"]:
            touched = own.filter("fresh > 0 OR overwritten > 0").select("event_type", "dt")
            metrics = metrics_of(sinks.only_partitions(stored, touched, ("event_type", "dt")))
            accepted, rejected = sinks.publish_metrics(metrics, root, f"gold-stream-{batch_id}")
        record = run_record(
            session, f"gold-stream-{batch_id}", "succeeded", started, "gold", "gold", datetime.now(tz=timezone.utc),
            metrics=json.dumps({**counts.asDict(), "gold_written": accepted, "rejected": rejected}),
        )
        sinks.append_runs(record, f"{root}/runs")

    stream = changes(source.parquet(silver)).writeStream.outputMode("update").foreachBatch(write)
    with settings(spark, STATE_CONF):
        return _start(stream.option("checkpointLocation", f"{checkpoint}/stream"), trigger)


def _silver_ddl() -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SILVER_SCHEMA) + ", batch BIGINT"


def current_silver(spark: SparkSession, root: str) -> DataFrame:
    """Stored Silver rows of all batches, each row of an event that came more than once."""
    return spark.read.schema(_silver_ddl()).parquet(f"{root}/silver/events")


def latest_silver(spark: SparkSession, root: str) -> DataFrame:
    """Silver with the last write of each event over all batches."""
    return last_write(current_silver(spark, root), SILVER_IDENTITY, ("landed_at", "batch"))


def refresh_gold(spark: SparkSession, root: str, touched: DataFrame) -> None:
    """Recompute the listed (type, day) metrics from the full Silver partitions, as after a repair of Silver."""
    rows = sinks.only_partitions(current_silver(spark, root), touched, ("event_type", "dt"))
    latest = last_write(rows, SILVER_IDENTITY, ("landed_at", "batch"))
    sinks.publish_metrics(daily_metrics(latest, ordered=False), root, "gold-refresh")


def fold_batches(spark: SparkSession, root: str, up_to_batch: int, first_day: str, last_day: str) -> int:
    """Fold the batches of a range of days into one folder per (type, day).

    The folded rows replace the folder of ``up_to_batch``, then the older folders
    go. Between the two steps a row may be stored twice; readers that keep the
    last write see it once. Returns the number of folders deleted.
    """
    older = current_silver(spark, root).filter(
        F.col("dt").between(first_day, last_day) & (F.col("batch") <= F.lit(up_to_batch))
    )
    folded = last_write(older, SILVER_IDENTITY, ("landed_at", "batch")).withColumn("batch", F.lit(up_to_batch).cast("bigint"))
    path = f"{root}/silver/events"
    folders = inventory(spark, path).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
    batch = K.hive_value(F.col("path"), "batch").try_cast("bigint")
    stale = folders.filter(
        K.day_of_key(F.col("path")).between(first_day, last_day) & (batch < F.lit(up_to_batch))
    )
    gone = materialize(stale, "stale")
    sinks.write_partitions(folded, path, ("event_type", "dt", "batch"))
    deleted = delete_paths(gone, scratch_path(spark, "fold")).first()["deleted"]
    spark.catalog.refreshByPath(path)
    return deleted
