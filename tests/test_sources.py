from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleanse as C
from tidemark.operators import merge as MG
from tidemark.sources import catalog, deadletter, generator, objects, sinks
from tidemark.sources.notifications import extract_refs, undecodable
from tidemark.sources.storage import delete_paths
from tidemark.streaming import records


def record(bucket="land", key="events%2Fdt%3D2026-01-02%2Fa+b.json", **more):
    return {"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": bucket}, "object": {"key": key}}, **more}


def refs(bronze, *messages):
    rows = extract_refs(bronze(*messages)).collect()
    return sorted((r["bucket"], r["key"], r["event_name"], r["source"]) for r in rows)


def test_native_notification(bronze):
    got = refs(bronze, {"Records": [record(), record(bucket="b2", key="k")]})
    assert got == [("b2", "k", "ObjectCreated:Put", "s3"), ("land", "events/dt=2026-01-02/a b.json", "ObjectCreated:Put", "s3")]


def test_queue_wrapped_notifications(bronze):
    inner = {"Records": [record(key="k1"), {"no": "object"}]}
    text = {"Records": [{"eventSource": "aws:sqs", "body": json.dumps(inner)}]}
    nested = {"Records": [{"body": {"Records": [record(key="k2")]}}, record(key="k3")]}
    bus_in_queue = {"Records": [{"eventSource": "aws:sqs", "body": json.dumps({"detail": {"bucket": {"name": "b"}, "object": {"key": "k4"}}})}]}
    assert [(k, s) for _, k, _, s in refs(bronze, text, nested, bus_in_queue)] == [
        ("k4", "eventbridge"), ("k1", "sqs"), ("k2", "sqs"), ("k3", "s3"),
    ]


def test_bus_event(bronze):
    message = {"detail-type": "Object Created", "detail": {"bucket": {"name": "land"}, "object": {"key": "a%20b"}}}
    assert refs(bronze, message) == [("land", "a b", "Object Created", "eventbridge")]


def test_poison_names_nothing(bronze):
    poison = ["not json", "null", "[]", {"hello": "world"}, {"Records": "x"}, {"Records": [1, None]},
              {"Records": [{"eventSource": "aws:sqs", "body": "junk"}]}, {"Records": [record(bucket="")]}]
    assert refs(bronze, *poison) == []
    assert undecodable(bronze(*poison)).count() == 3


def test_arrivals_and_manifest(spark):
    wanted = spark.createDataFrame([("events/a",), ("events/b",), ("logs/c",)], "key STRING")
    present = spark.createDataFrame([("events/a",), ("events/a",), ("logs/c",)], "key STRING")
    assert {(r["key"], r["outcome"]) for r in objects.arrivals(wanted, present).collect()} == {
        ("events/a", "accepted"), ("events/b", "missing"), ("logs/c", "skipped"),
    }
    assert [r["key"] for r in objects.missing(wanted, present).collect()] == ["events/b"]
    assert sorted(r["key"] for r in objects.found(wanted, present).collect()) == ["events/a", "logs/c"]
    everything = spark.createDataFrame([("events/x",), ("logs/y",)], "key STRING")
    assert [r["key"] for r in objects.select_scope(wanted.filter("false"), everything).collect()] == ["events/x"]
    assert sorted(r["key"] for r in objects.select_scope(wanted, everything).collect()) == ["events/a", "events/b"]


def test_json_objects_and_inventory(spark, tmp_root, event):
    folder = f"{tmp_root}/events/dt=2026-01-02"
    os.makedirs(folder)
    for name, text in (("a", json.dumps(event(), indent=2)), ("b", " \n"), ("c", "junk")):
        with open(f"{folder}/{name}.json", "w") as out:
            out.write(text)
    listed = objects.inventory(spark, tmp_root)
    assert listed.columns == ["path", "modificationTime", "length"] and listed.count() == 3
    rows = C.inspect(objects.read_json_objects(spark, tmp_root)).collect()
    assert sorted(str(r["reason"]) for r in rows) == ["None", "empty_record", "missing_event_id"]


def test_dead_letters(spark, tmp_root):
    rows = [(f"m{i}", None if i == 1 else "x" * (300 if i == 2 else 5), 1, i) for i in range(12)]
    messages = spark.createDataFrame(rows, "message_id STRING, body STRING, receive_count BIGINT, s INT")
    messages = messages.withColumn("enqueued_at", F.timestamp_seconds("s"))
    root = f"{tmp_root}/dlq"
    deadletter.append(messages, root, "batch-1")
    deadletter.append(messages, root, "batch-1")
    assert deadletter.waiting(spark, root).count() == 12
    long = deadletter.summaries(deadletter.waiting(spark, root)).filter("message_id = 'm2'").first()
    assert long["body_preview"] == "x" * 237 + "..." and long["body_bytes"] == 300
    first = deadletter.redrive(spark, root, f"{tmp_root}/source", 3)
    assert first == {"moved": ["m0", "m2"], "errors": ["m1: empty body"]}
    assert deadletter.waiting(spark, root).count() == 10
    assert spark.read.parquet(f"{tmp_root}/source").count() == 2


def test_preview_counts_characters_and_bytes(spark):
    row = spark.createDataFrame([("m", "é" * 240, 1)], "message_id STRING, body STRING, receive_count BIGINT")
    got = deadletter.summaries(row).first()
    assert got["body_preview"] == "é" * 240 and got["body_bytes"] == 480


def test_generator_sequence(spark):
    rows = generator.generate_events(spark, 60, seed=42).orderBy("event_id").collect()
    for i in (0, 1, 7, 59):
        n = (42 * 1103515245 + i * 12345) & 0x7FFFFFFF
        row = rows[i]
        assert row["event_id"] == f"evt-0042-{i:06d}"
        assert row["event_type"] == ["page_view", "add_to_cart", "purchase", "refund"][n % 4]
        assert row["user_id"] == f"user-{(n // 7) % 50:03d}"
        assert row["quantity"] == n % 5 + 1 and row["amount_usd"] == round((n % 90 + 10) * 1.25, 2)
        assert row["country"] == ["US", "DE", "IN", "BR", "JP"][n % 5]
    with pytest.raises(ValueError):
        generator.generate_events(spark, -1)


def test_generated_events_are_all_valid(spark):
    landed = generator.as_json(generator.generate_events(spark, 100))
    rows = C.inspect(landed)
    assert rows.filter("reason IS NULL AND size(checks) = 0").count() == 100


def test_stream_records_round_trip(spark):
    events = generator.generate_events(spark, 5)
    for newline in (False, True):
        sent = records.encode(events, newline)
        text = sent.select("key", records.decode(F.col("data")).alias("raw"), "bytes")
        row = text.orderBy("raw").first()
        body = json.loads(row["raw"])
        assert body["user_id"] == row["key"] and body["event_id"] == "evt-0042-000000"
        assert row["bytes"] == len(row["raw"].encode())
    plain = spark.createDataFrame([(' {"a":1} ',)], "data STRING")
    assert plain.select(records.decode(F.col("data"))).first()[0] == '{"a":1}'


def test_merge_shapes(spark):
    texts = ['{"id":"a"}', '[{"id":"b"}, 5]', '{"events":[{"id":"c"},{"id":"d"},null]}', '{"_raw":[{"id":"e"}]}', "junk", "7"]
    stored = spark.createDataFrame([("d1", t) for t in texts], "dt STRING, raw STRING")
    assert tuple(MG.merge_events(stored, ("dt",)).first()) == ("d1", 5, 6)
    ids = MG.flatten(stored, ("dt",), MG.EVENT_LISTS).select(F.try_variant_get("record", "$.id", "string")).collect()
    assert sorted(r[0] for r in ids) == ["a", "b", "c", "d", "e"]


def test_merge_quarantine_shapes(spark):
    texts = ['{"reason":"r","zone":"gold","payload":{"event_type":"page_view","dt":"2026-01-02","events":0}}'] * 2
    texts.append('{"reason":"r","rejected":[{"reason":"r","metric":"m"}]}')
    stored = spark.createDataFrame([("r", t) for t in texts], "reason STRING, raw STRING")
    assert tuple(MG.merge_quarantine(stored, ("reason",)).first()) == ("r", 3, 3)
    flat = MG.flatten(stored, (), MG.QUARANTINE_LISTS)
    labels = flat.select(*[c.alias(n) for n, c in MG.quarantine_labels(F.col("record")).items()]).distinct().collect()
    assert {tuple(r) for r in labels} == {("r", "page_view", "2026-01-02"), ("r", "m", "")}


def test_delete_paths(spark, tmp_root):
    os.makedirs(f"{tmp_root}/a/b")
    for name in ("a/b/1", "2"):
        open(f"{tmp_root}/{name}", "w").close()
    paths = spark.createDataFrame([(f"file:{tmp_root}/a",), (f"{tmp_root}/2",), (f"{tmp_root}/gone",)], "path STRING")
    record = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    assert tuple(delete_paths(paths, record).first()) == (3, 3, 0, None)
    assert os.listdir(tmp_root) == []


def test_deletion_goes_on_with_its_recorded_list(spark, tmp_root):
    from tidemark.sources import storage

    for name in "abc":
        os.makedirs(f"{tmp_root}/{name}")
    record = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    paths = spark.createDataFrame([(f"{tmp_root}/{n}",) for n in "abc"], "path STRING")
    # An attempt that listed all three and died behind the first.
    paths.write.parquet(f"{record}/planned")
    spark.createDataFrame([(f"{tmp_root}/a", True, None)], storage.RESULT).write.parquet(f"{record}/done")
    storage.remove(spark, f"{tmp_root}/a")
    os.makedirs(f"{tmp_root}/a")  # made anew since: no longer on the list
    assert tuple(delete_paths(paths.limit(0), record).first()) == (3, 3, 0, None)
    assert os.listdir(tmp_root) == ["a"]


def test_catalog_tables(spark, tmp_root, bronze, event):
    from tidemark.operators import gold as G

    rows = C.accepted(C.cleanse(bronze(event(), event(event_id="evt-2", event_type="refund")), "2026-01-10T00:00:00Z"))
    sinks.write_silver(rows, f"{tmp_root}/silver")
    sinks.write_gold(G.daily_metrics(rows), f"{tmp_root}/gold")
    names = catalog.register(spark, f"{tmp_root}/silver", f"{tmp_root}/gold", "zones")
    assert names == ["zones.commerce_event_conformed", "zones.daily_event_metrics"]
    assert spark.table(names[0]).count() == 2
    assert {(r["metric"], r["dt"], r["events"]) for r in spark.table(names[1]).collect()} == {
        ("purchase", "2026-01-02", 1), ("refund", "2026-01-02", 1),
    }
    assert dict(catalog.split_columns(__import__("tidemark.schemas", fromlist=["x"]).GOLD_CONTRACT, {"metric": "event_type"})[0]) == {
        "events": "BIGINT", "amount_usd": "DOUBLE",
    }


def test_upsert_replaces_one_event_and_keeps_the_rest(spark, tmp_root, bronze, event):
    path = f"{tmp_root}/silver"

    def land(*records):
        return C.accepted(C.cleanse(bronze(*records), "2026-01-10T00:00:00Z"))

    sinks.write_silver(land(event(), event(event_id="evt-2"), event(event_id="evt-3", event_ts="2026-01-05T00:00:00Z")), path)
    later = land(event(amount_usd=99.0)).withColumn("landed_at", F.expr("landed_at + INTERVAL 1 DAY"))
    sinks.upsert_silver(later, path)
    got = {(r["event_id"], r["amount_usd"]) for r in sinks.read_silver(spark, path).collect()}
    assert got == {("evt-1", 99.0), ("evt-2", 19.5), ("evt-3", 19.5)}


def test_catalog_table_follows_a_moved_location(spark, tmp_root):
    from tidemark.schemas import GOLD_CONTRACT
    from tidemark.sources import catalog

    schema = "dt STRING, event_type STRING, events BIGINT, amount_usd DOUBLE"
    sinks.write_gold(spark.createDataFrame([("2026-01-01", "purchase", 1, 1.0)], schema), f"{tmp_root}/a")
    sinks.write_gold(spark.createDataFrame([("2026-01-02", "refund", 7, 2.0)], schema), f"{tmp_root}/b")
    names = {
        catalog.create_table(spark, GOLD_CONTRACT, f"{tmp_root}/{part}", {"metric": "event_type"}, database="moved_zone")
        for part in "ab"
    }
    assert [r["events"] for r in spark.table(names.pop()).collect()] == [7]
    spark.sql("DROP DATABASE moved_zone CASCADE")
