"""Gold by partial sums and the ledger of Silver batches."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.operators.gold import daily_metrics
from tidemark.sources import sinks, storage
from tidemark.streaming import jobs

MARK = "2026-01-20T00:00:00Z"


def send(root, name, rows):
    """One file of records, one batch."""
    os.makedirs(f"{root}/source", exist_ok=True)
    with open(f"{root}/source/{name}.json", "w") as out:
        for row in rows:
            out.write(json.dumps({"key": row["user_id"], "data": json.dumps(row)}) + "\n")


def silver(spark, root, checkpoint="silver", **more):
    stream = jobs.record_stream(spark, f"{root}/source", files_per_batch=1)
    jobs.silver_stream(stream, root, f"{root}/check/{checkpoint}", MARK, **more).awaitTermination()


def gold(spark, root):
    jobs.gold_stream(spark, root, f"{root}/check/gold").awaitTermination()
    return {(r["metric"], r["dt"]): (r["events"], r["amount_usd"]) for r in sinks.read_gold(spark, f"{root}/gold/metrics").collect()}


def last_counts(spark, root):
    runs = sinks.read_runs(spark, f"{root}/runs").filter("step = 'gold'").orderBy(F.col("finished_at").desc())
    return json.loads(runs.first()["metrics"])


def test_partial_sums_equal_the_batch_query(spark, tmp_root, event):
    draw = random.Random(8)
    for at in range(5):
        rows = [
            event(
                event_id=f"e{draw.randint(0, 30)}",
                event_ts=f"2026-01-{draw.randint(1, 4):02d}T10:00:00Z",
                event_type=draw.choice(["purchase", "refund"]),
                amount_usd=round(draw.uniform(1, 99), 2),
            )
            for _ in range(25)
        ]
        send(tmp_root, f"f{at}", rows + rows[:3])
        silver(spark, tmp_root)
        found = gold(spark, tmp_root)
        want = daily_metrics(jobs.latest_silver(spark, tmp_root), ordered=False).collect()
        assert found == {(r["event_type"], r["dt"]): (r["events"], r["amount_usd"]) for r in want}
    runs = sinks.read_runs(spark, f"{tmp_root}/runs")
    assert runs.filter("step = 'gold'").count() == 5
    assert last_counts(spark, tmp_root)["overwritten"] > 0


def test_batch_reads_its_own_rows_and_the_partials_of_its_keys(spark, tmp_root, event):
    send(tmp_root, "a", [event(event_id="x", amount_usd=1.0), event(event_id="y", event_ts="2026-01-09T00:00:00Z", amount_usd=2.0)])
    silver(spark, tmp_root)
    gold(spark, tmp_root)
    # Without the rows of the first batch, and with unreadable partials of the other day.
    for folder in ("event_type=purchase/dt=2026-01-02", "event_type=purchase/dt=2026-01-09"):
        storage.remove(spark, f"{tmp_root}/silver/events/{folder}/batch=0")
    other = f"{tmp_root}/check/gold/partials/dt=2026-01-09/batch=0"
    for name in os.listdir(other):
        if name.endswith(".parquet"):
            with open(f"{other}/{name}", "w") as spoiled:
                spoiled.write("no longer a table")
    send(tmp_root, "b", [event(event_id="x", amount_usd=5.0), event(event_id="z", amount_usd=0.5)])
    silver(spark, tmp_root)
    assert gold(spark, tmp_root) == {("purchase", "2026-01-02"): (2, 5.5), ("purchase", "2026-01-09"): (1, 2.0)}
    assert {k: v for k, v in last_counts(spark, tmp_root).items() if k != "gold_written"} == {
        "fresh": 1, "overwritten": 1, "unchanged": 0, "rejected": 0
    }


def test_half_done_and_repeated_batches(spark, tmp_root, event):
    send(tmp_root, "a", [event(event_id="1"), event(event_id="")])
    send(tmp_root, "b", [event(event_id="2"), event(event_id="3", quantity=0)])

    def die(number, step):
        if (number, step) == (1, "silver"):
            raise RuntimeError("ends here")

    with pytest.raises(StreamingQueryException):
        silver(spark, tmp_root, interrupt=die)
    silver(spark, tmp_root)
    silver(spark, tmp_root, checkpoint="lost")
    assert jobs.current_silver(spark, tmp_root).count() == 2
    assert spark.read.parquet(f"{tmp_root}/silver/quarantine").count() == 2
    runs = sinks.read_runs(spark, f"{tmp_root}/runs").groupBy("run_id").agg(F.sort_array(F.collect_list("status")).alias("s"))
    assert sorted(r["s"] for r in runs.collect()) == [["running", "running", "succeeded"], ["running", "succeeded"]]
    # Another batch under the new checkpoint does not take the number of an old one.
    send(tmp_root, "c", [event(event_id="4")])
    silver(spark, tmp_root, checkpoint="lost")
    assert {r["batch"] for r in jobs.current_silver(spark, tmp_root).select("batch").distinct().collect()} == {0, 1, 2}
    assert gold(spark, tmp_root) == {("purchase", "2026-01-02"): (3, 58.5)}


def test_metrics_that_break_the_contract_are_set_aside(spark, tmp_root, event, monkeypatch):
    from tidemark.streaming import jobs as module

    send(tmp_root, "a", [event(event_id="1", amount_usd=3.0), event(event_id="2", event_type="refund", amount_usd=1.0)])
    silver(spark, tmp_root)
    real = module.metrics_of
    spoil = F.when(F.col("event_type") == "refund", -F.col("amount_usd")).otherwise(F.col("amount_usd"))
    monkeypatch.setattr(module, "metrics_of", lambda rows: real(rows).withColumn("amount_usd", spoil))
    assert gold(spark, tmp_root) == {("purchase", "2026-01-02"): (1, 3.0)}
    rejected = sinks.read_gold_quarantine(spark, f"{tmp_root}/gold/quarantine").first()
    assert (rejected["reason"], rejected["metric"], rejected["dt"]) == ("negative_amount", "refund", "2026-01-02")
    assert last_counts(spark, tmp_root)["rejected"] == 1


def test_drain_by_ten_messages(spark, tmp_root):
    os.makedirs(f"{tmp_root}/queue")
    ref = '{{"Records":[{{"s3":{{"bucket":{{"name":"land"}},"object":{{"key":"k{}"}}}}}}]}}'
    for part in range(2):
        lines = [ref.format(f"{part}-{i}") for i in range(25)]
        lines[13] = "not json"
        with open(f"{tmp_root}/queue/{part}.txt", "w") as out:
            out.write("\n".join(lines) + "\n")
    messages = jobs.message_stream(spark, f"{tmp_root}/queue", files_per_batch=1)
    jobs.drain_messages(messages, f"{tmp_root}/refs", f"{tmp_root}/dlq", f"{tmp_root}/check").awaitTermination()
    units = spark.read.parquet(f"{tmp_root}/refs-invocations").collect()
    assert sorted((int(r["batch"]), r["invocation"], r["messages"], r["failed"]) for r in units) == [
        (b, *unit) for b in (0, 1) for unit in ((0, 10, 0), (1, 10, 1), (2, 5, 0))
    ]
    assert spark.read.parquet(f"{tmp_root}/refs").count() == 48
    from tidemark.sources import deadletter

    assert {r["body"] for r in deadletter.waiting(spark, f"{tmp_root}/dlq").collect()} == {"not json"}


def test_producer_counts_what_each_sink_took(spark, tmp_root):
    from tidemark.operators import runs as R
    from tidemark.streaming import producer, records

    texts = ['{"event_id":"a","user_id":"u1"}', "not json", '{"event_id":"b","user_id":"","x":"' + "y" * 90 + '"}', "{}", None]
    spark.createDataFrame([(t,) for t in texts], "raw STRING").coalesce(1).write.parquet(f"{tmp_root}/posted")
    stream = spark.readStream.schema("raw STRING").parquet(f"{tmp_root}/posted")
    limits = {"records": 31, "delivery": 31}
    producer.produce(stream, tmp_root, f"{tmp_root}/check", limits).awaitTermination()
    counts = {r["name"]: int(r["value"]) for r in R.counters(sinks.read_runs(spark, f"{tmp_root}/runs")).collect()}
    assert counts == {
        "records.sent": 1, "records.failed": 4, "records.undecodable": 3, "records.oversized": 1, "records.bytes": 31,
        "delivery.sent": 0, "delivery.failed": 5, "delivery.undecodable": 3, "delivery.oversized": 2, "delivery.bytes": 0,
    }
    kept = producer.sent(spark, tmp_root, "records")
    row = kept.filter("outcome = 'sent'").select("key", records.decode(F.col("data")).alias("text")).first()
    assert tuple(row) == ("u1", texts[0])
    assert kept.filter("outcome = 'failed' AND raw = 'not json' AND reason = 'undecodable'").count() == 1
    assert "9 records failed" in sinks.read_runs(spark, f"{tmp_root}/runs").first()["error"]
    # The same batch sent again replaces itself.
    producer.send(spark.read.parquet(f"{tmp_root}/posted"), tmp_root, "records", 0, 31)
    assert producer.sent(spark, tmp_root, "records").count() == 5
