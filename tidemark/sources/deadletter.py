"""Dead-letter table: append, inspect, redrive.

Messages and redrives are two append-only tables. The waiting messages are those
not yet in the redrive table, so moving a batch never rewrites the messages, and
repeating a redrive that died half-way moves at most the same batch again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import write_partitions

MESSAGE_SCHEMA = "message_id STRING, body STRING, receive_count BIGINT, enqueued_at TIMESTAMP"
DEFAULT_BATCH = 10
PREVIEW = 240


def append(messages: DataFrame, root: str, batch: str | None = None) -> None:
    """Add messages; a named batch replaces itself, so repeating it adds nothing."""
    rows = messages.select("message_id", "body", "receive_count", "enqueued_at")
    named = rows.withColumn("batch", F.lit(batch or f"manual-{uuid.uuid4().hex}"))
    write_partitions(named, f"{root}/messages", ("batch",), rebalance=False)


def waiting(spark: SparkSession, root: str) -> DataFrame:
    messages = spark.read.schema(f"{MESSAGE_SCHEMA}, batch STRING").parquet(f"{root}/messages").drop("batch")
    try:
        moved = spark.read.schema("message_id STRING").parquet(f"{root}/redriven")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return messages
    return messages.join(moved, "message_id", "left_anti")


def summaries(messages: DataFrame) -> DataFrame:
    """Preview of at most 240 characters, and the size in bytes."""
    body = F.coalesce("body", F.lit(""))
    preview = F.when(F.char_length(body) > PREVIEW, F.concat(F.substring(body, 1, PREVIEW - 3), F.lit("...")))
    return messages.select(
        "message_id",
        "receive_count",
        preview.otherwise(body).alias("body_preview"),
        F.octet_length(body).cast("bigint").alias("body_bytes"),
    )


def peek(messages: DataFrame, limit: int = DEFAULT_BATCH) -> DataFrame:
    """The oldest messages of a batch, not removed."""
    return messages.orderBy("enqueued_at", "message_id").limit(limit)


def redrive(spark: SparkSession, root: str, source_root: str, limit: int = DEFAULT_BATCH) -> dict:
    """Move the oldest batch back to the source folder.

    The source gets the bodies first, then the ids are recorded, so a failure in
    between repeats messages and loses none. A message without a body cannot be
    sent; it stays and is listed among the errors.
    """
    batch = peek(waiting(spark, root), limit).collect()
    good = [row for row in batch if row["body"] is not None]
    errors = [f"{row['message_id']}: empty body" for row in batch if row["body"] is None]
    if good:
        schema = "message_id STRING, body STRING"
        rows = spark.createDataFrame([(r["message_id"], r["body"]) for r in good], schema).coalesce(1)
        rows.select(F.col("body").alias("raw")).write.mode("append").parquet(source_root)
        rows.select("message_id").write.mode("append").parquet(f"{root}/redriven")
    return {"moved": [row["message_id"] for row in good], "errors": errors}
