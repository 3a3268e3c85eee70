"""Publishing events as records, with counts of what was sent and what failed by sink.

A batch is written once to every sink. The counts are observed on the rows as they pass
into the sink, so they cost no further pass and say what that write held. A record that a
sink does not take (an event that is no JSON object with an id, or a body over the sink's
size) goes to the sink's failures with its reason. Both folders and the run record bear
the number of the batch, so a repeated batch replaces what its first attempt sent.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import keys as K
from tidemark.operators.runs import run_record
from tidemark.sources import sinks

#: Most bytes of a record's body by sink; delivery to files ends a record in a line feed.
MOST_BYTES = {"records": 1 << 20, "delivery": 1000 << 10}
LINE_END = {"records": "", "delivery": "\n"}


def record_of(raw: Column, sink: str) -> tuple[Column, Column, Column]:
    """Partition key, base64 data and bytes of the record that an event text makes."""
    body = F.concat(raw, F.lit(LINE_END[sink])) if LINE_END[sink] else raw
    key = K.or_unknown(F.get_json_object(raw, "$.user_id"))
    return key, F.base64(F.encode(body, "UTF-8")), F.octet_length(body).cast("bigint")


def for_sink(events: DataFrame, sink: str, most_bytes: int) -> DataFrame:
    """(key, data, bytes, reason, raw) of event texts; a null reason means that the sink takes it."""
    key, data, size = record_of(F.col("raw"), sink)
    event_id = F.get_json_object("raw", "$.event_id")
    reason = F.when(event_id.isNull() | (event_id == ""), "undecodable").when(size > most_bytes, "oversized")
    return events.select(key.alias("key"), data.alias("data"), size.alias("bytes"), reason.alias("reason"), "raw")


def send(batch: DataFrame, root: str, sink: str, batch_id: int, most_bytes: int) -> dict[str, int]:
    """Write one batch to a sink and its failures; the observed counts."""
    seen = Observation(f"{sink}-{batch_id}-{datetime.now(tz=timezone.utc).timestamp()}")
    ok = F.col("reason").isNull()
    rows = for_sink(batch, sink, most_bytes).observe(
        seen,
        F.count_if(ok).alias("sent"),
        F.count_if(~ok).alias("failed"),
        F.count_if(F.col("reason") == "undecodable").alias("undecodable"),
        F.count_if(F.col("reason") == "oversized").alias("oversized"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes"),
    )
    # One write for both: what was sent and what failed are partitions of the sink.
    outcome = F.when(ok, "sent").otherwise("failed").alias("outcome")
    stored = rows.select("key", F.when(ok, F.col("data")).alias("data"), "reason", F.when(~ok, F.col("raw")).alias("raw"), outcome)
    folder = f"{root}/{sink}/batch={batch_id}"
    stored.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("outcome").parquet(folder)
    return {k: int(v) for k, v in seen.get.items()}


def produce(
    events: DataFrame,
    root: str,
    checkpoint: str,
    most_bytes: dict[str, int] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Publish a stream of event texts (column raw) to every sink and log one run a batch.

    ``most_bytes`` names the sinks to send to with their limits, all by default.
    """
    limits = MOST_BYTES if most_bytes is None else most_bytes

    def write(batch: DataFrame, batch_id: int) -> None:
        started = datetime.now(tz=timezone.utc)
        counts = {sink: send(batch, root, sink, batch_id, most) for sink, most in limits.items()}
        failed = sum(c["failed"] for c in counts.values())
        metrics = {f"{sink}.{name}": n for sink, c in counts.items() for name, n in c.items()}
        record = run_record(
            batch.sparkSession, f"produce-{batch_id}", "succeeded", started, "bronze", "ingest", datetime.now(tz=timezone.utc),
            error=f"{failed} records failed" if failed else None, metrics=json.dumps(metrics),
        )
        sinks.append_runs(record, f"{root}/runs")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def sent(spark, root: str, sink: str) -> DataFrame:
    """Stored records of a sink, failures with their reason and text."""
    schema = "key STRING, data STRING, reason STRING, raw STRING, batch BIGINT, outcome STRING"
    return spark.read.schema(schema).parquet(f"{root}/{sink}")
