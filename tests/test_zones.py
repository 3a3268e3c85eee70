"""Stored zones: gated runs, reprocessing, maintenance, streams, views."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import maintenance as M
from tidemark.operators import partitions as PT
from tidemark.plans import flow, upkeep, views
from tidemark.sources import generator, objects, sinks, storage
from tidemark.streaming import jobs, records


@pytest.fixture
def landed(bronze, event):
    good = [event(event_id=f"e{i}", event_ts=f"2026-01-0{1 + i % 3}T10:00:00Z", amount_usd=1.5 * (i + 1)) for i in range(6)]
    return bronze(*good, event(event_id=""), event(quantity=0), {}, "junk")


def files(spark, path):
    return objects.inventory(spark, path, "*.parquet").count()


def test_run_passes_and_replays(spark, tmp_root, landed):
    first = flow.run_batch(spark, landed, tmp_root, "2026-01-03T00:00:00Z")
    assert (first["status"], first["valid"], first["quarantined"], first["gold_written"]) == ("succeeded", 6, 4, 3)
    gold = sinks.read_gold(spark, f"{tmp_root}/gold/metrics").orderBy("dt").collect()
    assert [(r["dt"], r["events"], r["amount_usd"]) for r in gold] == [("2026-01-01", 2, 7.5), ("2026-01-02", 2, 10.5), ("2026-01-03", 2, 13.5)]
    before = files(spark, tmp_root)
    again = flow.run_batch(spark, landed, tmp_root, "2026-01-03T00:00:00Z")
    assert again["replay"] and again["run_id"] == first["run_id"]
    assert files(spark, tmp_root) == before
    rejected = spark.read.parquet(f"{tmp_root}/silver/quarantine")
    assert rejected.count() == 4 and rejected.filter("payload IS NULL").count() == 0
    report = sinks.recent_reports(spark, f"{tmp_root}/silver/quality").first()
    assert report["passed"] and report["rows_scanned"] == 6


def test_failed_gate_blocks_gold(spark, tmp_root, bronze, event):
    frame = bronze(event(), event(event_id="e2", user_id=""))
    result = flow.run_batch(spark, frame, tmp_root, "2026-01-03T00:00:00Z")
    assert (result["status"], result["action"], result["gold_written"]) == ("quality_failed", "fail", 0)
    assert sinks.read_silver(spark, f"{tmp_root}/silver/events").count() == 2
    run = sinks.read_runs(spark, f"{tmp_root}/runs").first()
    assert run["error"] == "quality gate failed: required_dimensions"
    assert not flow.run_batch(spark, frame, tmp_root, "2026-01-03T00:00:00Z")["replay"]


def test_quarantine_mode_can_promote_the_clean_rows(spark, tmp_root, bronze, event):
    frame = bronze(event(), event(event_id="e2", user_id=""))
    result = flow.run_batch(spark, frame, tmp_root, "2026-01-03T00:00:00Z", on_fail="quarantine", promote_clean=True)
    assert (result["passed"], result["gold_written"], result["status"]) == (False, 1, "succeeded")
    assert sinks.read_gold(spark, f"{tmp_root}/gold/metrics").first()["events"] == 1
    reasons = {r["reason"] for r in spark.read.parquet(f"{tmp_root}/silver/quarantine").collect()}
    assert reasons == {"required_dimensions"}


def test_reprocess_rewrites_only_the_window(spark, tmp_root, landed):
    flow.run_batch(spark, landed, tmp_root, "2026-01-03T00:00:00Z")
    spoiled = spark.createDataFrame(
        [("2026-01-01", "purchase", 99, 99.0), ("2026-01-03", "purchase", 99, 99.0)], "dt STRING, event_type STRING, events BIGINT, amount_usd DOUBLE"
    )
    sinks.write_gold(spoiled, f"{tmp_root}/gold/metrics")
    result = flow.reprocess(spark, tmp_root, "2026-01-03", 1)
    assert (result["gold_written"], result["silver_in_window"]) == (2, 4)
    gold = {r["dt"]: r["events"] for r in sinks.read_gold(spark, f"{tmp_root}/gold/metrics").collect()}
    assert gold == {"2026-01-01": 99, "2026-01-02": 2, "2026-01-03": 2}
    assert sinks.read_runs(spark, f"{tmp_root}/runs").filter("step = 'reprocess'").count() == 1


def test_reconcile(spark, landed):
    from tidemark.operators import cleanse as C

    row = flow.reconcile(C.cleanse(landed, "2026-01-03T00:00:00Z", gate=True)).first()
    assert (row["seeded"], row["valid"], row["quarantined"], row["gold"], row["gold_events"]) == (10, 6, 4, 3, 6)
    assert row["gate_passed"] and row["gold_matches_silver"] and row["balanced"]


@pytest.mark.parametrize("day,action,age", [("2026-06-03", "keep", 90), ("2026-06-02", "expire", 91), ("2026-01-01", "expire", 243)])
def test_expire_boundary_is_kept(spark, day, action, age):
    frame = spark.createDataFrame([(day, 1)], "dt STRING, objects INT")
    row = M.expire_partitions(frame, "2026-09-01", 90, "gold.daily_metrics").first()
    assert (row["cutoff"], row["action"], row["age_days"]) == ("2026-06-03", action, age)


@pytest.mark.parametrize("written,action", [("2026-08-18 00:00:00", "keep"), ("2026-08-17 23:59:59", "expire")])
def test_object_expiry_boundary(spark, written, action):
    frame = spark.createDataFrame([(written,)], "w STRING").selectExpr("CAST(w AS TIMESTAMP) AS written_at")
    row = M.expire_objects(frame, "2026-09-01T00:00:00Z", 14, "silver.quarantine").first()
    assert row["action"] == action and row["age_days"] == 14.0


@pytest.mark.parametrize("count,action", [(8, "keep"), (9, "compact")])
def test_compact_boundary_is_kept(spark, count, action):
    frame = spark.createDataFrame([("2026-01-02", count)], "dt STRING, objects INT")
    assert M.compact_plan(frame, 8, "bronze.raw_events").first()["action"] == action


def _fragments(spark, path, days=("2026-01-02", "2026-08-30"), copies=4):
    for i in range(copies):
        rows = spark.createDataFrame([(f"k{i}", d) for d in days], "raw STRING, dt STRING")
        rows.coalesce(1).write.mode("append").partitionBy("dt").parquet(path)


def test_compaction_keeps_every_row(spark, tmp_root):
    path = f"{tmp_root}/bronze/events"
    _fragments(spark, path)
    plan = upkeep.partition_plan(spark, path, "bronze.raw_events", "2026-09-01", retention_days=400, max_objects=3)
    assert {r["action"] for r in plan.collect()} == {"compact"}
    upkeep.compact(spark, path, plan.filter("dt = '2026-01-02'"))
    counts = {r["dt"]: r["objects"] for r in PT.objects_per_partition(objects.inventory(spark, path), ("dt",)).collect()}
    assert counts == {"2026-01-02": 1, "2026-08-30": 4}
    assert spark.read.parquet(path).count() == 8


@pytest.mark.parametrize("stop", ["staged", "aside"])
def test_compaction_that_died_is_completed(spark, tmp_root, stop):
    path = f"{tmp_root}/bronze/events"
    _fragments(spark, path)
    plan = upkeep.partition_plan(spark, path, "bronze.raw_events", "2026-09-01", retention_days=400, max_objects=3)

    def die(step):
        if stop == "aside":
            pair = spark.read.parquet(f"{path}/_compact/record/swaps").orderBy("live").first()
            storage.move(spark, pair["live"], pair["aside"])
        raise RuntimeError("ends here")

    with pytest.raises(RuntimeError, match="ends here"):
        upkeep.compact(spark, path, plan, interrupt=die)
    assert files(spark, path) == (8 if stop == "staged" else 4)
    upkeep.compact(spark, path, plan.limit(0))
    rows = spark.read.parquet(path)
    assert sorted((r["raw"], r["dt"]) for r in rows.collect()) == sorted(
        (f"k{i}", d) for i in range(4) for d in ("2026-01-02", "2026-08-30")
    )
    assert files(spark, path) == 2 and not storage.exists(spark, f"{path}/_compact")


def test_compaction_before_its_record_is_dropped_and_a_half_swap_can_be_undone(spark, tmp_root):
    path = f"{tmp_root}/bronze/events"
    _fragments(spark, path)
    spark.range(1).write.parquet(f"{path}/_compact/staged/dt=2026-01-02")
    assert upkeep.finish_compaction(spark, path) == 0 and files(spark, path) == 8
    live, record = f"{path}/dt=2026-01-02", f"{path}/_compact/record"
    spark.range(1).write.parquet(f"{path}/_compact/staged/dt=2026-01-02")
    pair = (f"{path}/_compact/staged/dt=2026-01-02", live, f"{path}/_compact/aside/dt=2026-01-02")
    spark.createDataFrame([pair], "staged STRING, live STRING, aside STRING").write.parquet(f"{record}/swaps")
    storage.move(spark, live, pair[2])
    assert storage.undo_swaps(spark, record) == 1
    assert spark.read.parquet(path).count() == 8


def test_maintain_expires_before_it_compacts(spark, tmp_root):
    path = f"{tmp_root}/bronze/events"
    _fragments(spark, path)
    dry = upkeep.maintain(spark, path, "bronze.raw_events", "2026-09-01", max_objects=3).first()
    assert (dry["expire_count"], dry["compact_count"], dry["deleted_count"], dry["applied"]) == (1, 1, 0, False)
    assert spark.read.parquet(path).count() == 8
    wet = upkeep.maintain(spark, path, "bronze.raw_events", "2026-09-01", apply=True, max_objects=3).first()
    assert (wet["expire_count"], wet["compact_count"], wet["deleted_count"], wet["applied"]) == (1, 1, 1, True)
    left = spark.read.parquet(path)
    assert left.count() == 4 and {r["dt"] for r in left.select("dt").distinct().collect()} == {"2026-08-30"}
    assert files(spark, path) == 1


def test_quarantine_expires_by_object_age(spark, tmp_root):
    path = f"{tmp_root}/silver/quarantine"
    spark.createDataFrame([("a", "r1"), ("b", "r2")], "payload STRING, reason STRING").write.partitionBy("reason").parquet(path)
    kept = upkeep.expire_objects(spark, path, "silver.quarantine", "2026-01-01T00:00:00Z")
    assert tuple(kept.first()) == (0, 0, 0, None)
    gone = upkeep.expire_objects(spark, path, "silver.quarantine", "2099-01-01T00:00:00Z")
    assert gone.first()["deleted"] >= 2 and gone.first()["failed"] == 0 and files(spark, path) == 0


def test_platform_maintenance_sums_zones(spark, tmp_root):
    _fragments(spark, f"{tmp_root}/bronze/events", copies=2)
    gold = spark.createDataFrame([("2026-01-02", "purchase", 1, 1.0)], "dt STRING, event_type STRING, events BIGINT, amount_usd DOUBLE")
    sinks.write_gold(gold, f"{tmp_root}/gold/metrics")
    reports = upkeep.maintain_platform(spark, tmp_root, "2026-09-01")
    assert [r["dataset"] for r in reports.collect()] == ["bronze.raw_events", "gold.daily_metrics"]
    assert tuple(upkeep.platform_totals(reports).first()) == (2, 0, 0)


def test_expired_partitions_leave_the_catalog(spark, tmp_root):
    path = f"{tmp_root}/bronze/events"
    _fragments(spark, path, copies=1)
    spark.sql("CREATE DATABASE IF NOT EXISTS upkeep")
    spark.sql("DROP TABLE IF EXISTS upkeep.raw_events")
    spark.sql(f"CREATE TABLE upkeep.raw_events (raw STRING, dt STRING) USING parquet PARTITIONED BY (dt) LOCATION '{path}'")
    spark.catalog.recoverPartitions("upkeep.raw_events")
    plan = upkeep.partition_plan(spark, path, "bronze.raw_events", "2026-09-01")
    upkeep.expire(spark, path, plan, "upkeep.raw_events")
    assert [r[0] for r in spark.sql("SHOW PARTITIONS upkeep.raw_events").collect()] == ["dt=2026-08-30"]


def test_named_queries(spark):
    gold = spark.createDataFrame(
        [("purchase", "2026-01-02", 2, 5.0), ("refund", "2026-01-09", 1, 1.0)], "metric STRING, dt STRING, events BIGINT, amount_usd DOUBLE"
    )
    views.create_views(spark, gold=gold)
    assert [r["dt"] for r in views.run_named(spark, "gold_daily_totals").collect()] == ["2026-01-02", "2026-01-09"]
    assert [r["dt"] for r in views.run_named(spark, "gold_last_7_days", "2026-01-09").collect()] == ["2026-01-09"]
    assert views.run_named(spark, "gold_last_7_days", "2026-01-08").count() == 2
    assert views.run_named(spark, "gold_last_7_days").count() == 0
    assert views.run_named(spark, "fct_daily_purchase_revenue").first()["gmv_usd"] == 5.0
    with pytest.raises(KeyError, match="gold_daily_totals"):
        views.run_named(spark, "nope")


def test_stream_equals_batch_and_repeats_cleanly(spark, tmp_root):
    events = generator.generate_events(spark, 300)
    for part in range(3):
        records.publish(events.filter(F.crc32("event_id") % 3 == part).coalesce(1), f"{tmp_root}/source")
    landed = jobs.record_stream(spark, f"{tmp_root}/source", files_per_batch=1)
    jobs.medallion(landed, tmp_root, f"{tmp_root}/check", "2026-01-01T05:00:00Z", 0).awaitTermination()
    silver = jobs.current_silver(spark, tmp_root)
    assert silver.count() == 300 and silver.select("batch").distinct().count() == 3
    assert silver.filter("_late").count() == 300
    want = {(r["event_type"], r["events"], round(r["amount"], 2)) for r in events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("amount_usd").alias("amount")).collect()}
    gold = sinks.read_gold(spark, f"{tmp_root}/gold/metrics")
    assert {(r["metric"], r["events"], r["amount_usd"]) for r in gold.collect()} == want
    before = files(spark, f"{tmp_root}/silver")
    again = jobs.record_stream(spark, f"{tmp_root}/source", files_per_batch=1)
    jobs.medallion(again, tmp_root, f"{tmp_root}/check", "2026-01-01T05:00:00Z", 0).awaitTermination()
    assert files(spark, f"{tmp_root}/silver") == before
    jobs.medallion(again, tmp_root, f"{tmp_root}/lost-checkpoint", "2026-01-01T05:00:00Z", 0).awaitTermination()
    gold = sinks.read_gold(spark, f"{tmp_root}/gold/metrics")
    assert {(r["metric"], r["events"], r["amount_usd"]) for r in gold.collect()} == want


def test_late_event_reopens_its_day(spark, tmp_root, event):
    import json
    import os

    os.makedirs(f"{tmp_root}/source")

    def send(name, *rows):
        with open(f"{tmp_root}/source/{name}.json", "w") as out:
            for row in rows:
                out.write(json.dumps({"key": row["user_id"], "data": json.dumps(row)}) + "\n")
        jobs.medallion(
            jobs.record_stream(spark, f"{tmp_root}/source"), tmp_root, f"{tmp_root}/check", "2026-01-10T00:00:00Z"
        ).awaitTermination()
        return {(r["dt"], r["events"], r["amount_usd"]) for r in sinks.read_gold(spark, f"{tmp_root}/gold/metrics").collect()}

    old = event(event_ts="2026-01-01T00:00:00Z", amount_usd=1.0)
    assert send("a", old, event(event_id="n", event_ts="2026-01-09T00:00:00Z", amount_usd=2.0)) == {("2026-01-01", 1, 1.0), ("2026-01-09", 1, 2.0)}
    later = event(event_id="late", event_ts="2026-01-01T05:00:00Z", amount_usd=4.0)
    assert send("b", later) == {("2026-01-01", 2, 5.0), ("2026-01-09", 1, 2.0)}
    rewritten = event(event_ts="2026-01-01T00:00:00Z", amount_usd=3.0)
    assert send("c", rewritten) == {("2026-01-01", 2, 7.0), ("2026-01-09", 1, 2.0)}


def test_delivery_and_drain(spark, tmp_root):
    records.publish(generator.generate_events(spark, 50), f"{tmp_root}/source", newline=True)
    stream = jobs.record_stream(spark, f"{tmp_root}/source")
    jobs.deliver_bronze(stream, f"{tmp_root}/bronze", f"{tmp_root}/check").awaitTermination()
    bronze = spark.read.parquet(f"{tmp_root}/bronze")
    assert bronze.count() == 50 and {r["dt"] for r in bronze.select("dt").distinct().collect()} == {"2026-01-01"}


def test_folding_batches_keeps_the_last_write(spark, tmp_root, event):
    import json
    import os

    os.makedirs(f"{tmp_root}/source")
    for i, amount in enumerate((1.0, 2.0, 3.0)):
        rows = [event(event_id="same", amount_usd=amount), event(event_id=f"own-{i}")]
        with open(f"{tmp_root}/source/{i}.json", "w") as out:
            out.write("\n".join(json.dumps({"key": "u", "data": json.dumps(r)}) for r in rows) + "\n")
        jobs.medallion(
            jobs.record_stream(spark, f"{tmp_root}/source"), tmp_root, f"{tmp_root}/check", "2026-01-03T00:00:00Z"
        ).awaitTermination()
    assert jobs.current_silver(spark, tmp_root).count() == 6
    assert jobs.fold_batches(spark, tmp_root, 1, "2026-01-01", "2026-01-31") == 1
    rows = jobs.current_silver(spark, tmp_root)
    assert {r["batch"] for r in rows.collect()} == {1, 2} and rows.count() == 5
    jobs.refresh_gold(spark, tmp_root, rows.select("event_type", "dt").distinct())
    gold = sinks.read_gold(spark, f"{tmp_root}/gold/metrics").first()
    assert (gold["events"], gold["amount_usd"]) == (4, 3.0 + 3 * 19.5)


def test_arrival_run(spark, tmp_root, bronze):
    def message(*keys):
        return bronze({"Records": [{"s3": {"bucket": {"name": "land"}, "object": {"key": k}}} for k in keys]})

    present = spark.createDataFrame([("events/a",), ("events/b",)], "key STRING")
    first = flow.ingest(spark, message("events/a", "events/x", "logs/z"), present, tmp_root)
    assert (first["accepted"], first["skipped"], first["missing"], first["status"]) == (1, 1, 1, "succeeded")
    assert flow.ingest(spark, message("events/x", "events/a"), present, tmp_root)["replay"]
    failed = flow.ingest(spark, message("events/y"), present, tmp_root)
    assert (failed["status"], failed["replay"]) == ("failed", False)
    assert not flow.ingest(spark, message("events/y"), present, tmp_root)["replay"]


def test_seeded_zone_runs_clean(spark, tmp_root):
    generator.seed_bronze(spark, 200, f"{tmp_root}/bronze/events")
    landed = spark.read.schema("raw STRING, source_key STRING, landed_at TIMESTAMP, dt STRING").parquet(f"{tmp_root}/bronze/events")
    result = flow.run_batch(spark, landed, tmp_root, "2026-01-02T00:00:00Z", 3650)
    assert (result["valid"], result["quarantined"], result["late"], result["status"]) == (200, 0, 0, "succeeded")


def test_only_planned_partitions_are_read(spark, tmp_root):
    path = f"{tmp_root}/bronze/events"
    _fragments(spark, path, copies=1)
    wanted = spark.createDataFrame([("2026-01-02",)], "dt STRING")
    rows = sinks.only_partitions(spark.read.parquet(path), wanted, ("dt",))
    assert rows.count() == 1
    assert "PartitionFilters: [isnotnull(dt" in rows._jdf.queryExecution().executedPlan().toString()


def test_second_batch_keeps_stored_rows(spark, tmp_root, bronze, event):
    first = bronze(event(), event(event_id="evt-2"), event(event_id="evt-3"))
    flow.run_batch(spark, first, tmp_root, "2026-01-03T00:00:00Z")
    second = bronze(event(event_id="evt-4")).selectExpr("raw", "concat('b/', source_key) AS source_key", "landed_at")
    flow.run_batch(spark, second, tmp_root, "2026-01-03T00:00:00Z")
    assert sinks.read_silver(spark, f"{tmp_root}/silver/events").count() == 4
    assert sinks.read_gold(spark, f"{tmp_root}/gold/metrics").first()["events"] == 4


def test_clean_batch_does_not_publish_a_refused_one(spark, tmp_root, bronze, event):
    flow.run_batch(spark, bronze(event(user_id="")), tmp_root, "2026-01-03T00:00:00Z")
    other = bronze(event(event_id="evt-9", event_ts="2026-01-03T01:00:00Z")).selectExpr(
        "raw", "concat('b/', source_key) AS source_key", "landed_at"
    )
    assert flow.run_batch(spark, other, tmp_root, "2026-01-03T00:00:00Z")["passed"]
    assert [r["dt"] for r in sinks.read_gold(spark, f"{tmp_root}/gold/metrics").collect()] == ["2026-01-03"]


def test_retry_of_a_failed_run_adds_nothing(spark, tmp_root, bronze, event):
    frame = bronze(event(user_id=""), event(event_id="evt-2", quantity=0))
    for _ in range(2):
        flow.run_batch(spark, frame, tmp_root, "2026-01-03T00:00:00Z")
    assert spark.read.parquet(f"{tmp_root}/silver/quarantine").count() == 1
    assert sinks.recent_reports(spark, f"{tmp_root}/silver/quality").count() == 1


def test_ties_of_the_last_write_do_not_depend_on_the_layout(spark):
    from tidemark.operators.identity import last_write

    rows = spark.createDataFrame([(1, 5, f"v{i}") for i in range(40)], "k INT, at INT, v STRING")
    winners = {last_write(rows.repartition(n), ("k",), ("at",)).first()["v"] for n in (1, 2, 3, 7, 13)}
    assert len(winners) == 1


def test_compaction_keeps_the_folders_of_runs(spark, tmp_root):
    path = f"{tmp_root}/gold/quarantine"
    schema = "payload STRING, zone STRING, reason STRING, metric STRING, dt STRING"
    for run in ("r1", "r2"):
        rows = [(f"{run}-{i}", "gold", "negative_amount", "refund", "2026-01-02") for i in range(4)]
        frame = spark.createDataFrame(rows, schema).repartition(4)
        frame.write.partitionBy("reason", "metric", "dt").parquet(f"{path}/run_id={run}")
    assert files(spark, path) > 2 and upkeep.layout(spark, path) == ["run_id", "reason", "metric", "dt"]
    plan = upkeep.partition_plan(spark, path, "gold.quarantine", "2026-01-03", max_objects=1)
    upkeep.compact(spark, path, plan)
    assert files(spark, path) == 2
    left = sinks.read_gold_quarantine(spark, path)
    assert sorted((r["run_id"], r["payload"]) for r in left.collect()) == [(r, f"{r}-{i}") for r in ("r1", "r2") for i in range(4)]


def test_repeated_run_leaves_no_stale_rejects(spark, tmp_root):
    schema = "dt STRING, event_type STRING, events BIGINT, amount_usd DOUBLE"
    bad = spark.createDataFrame([("2026-01-02", "purchase", 1, -1.0), ("2026-01-02", "refund", 1, 1.0)], schema)
    assert sinks.publish_metrics(bad, tmp_root, "r1") == (1, 1)
    assert sinks.read_gold_quarantine(spark, f"{tmp_root}/gold/quarantine").count() == 1
    assert sinks.publish_metrics(bad.filter("amount_usd > 0"), tmp_root, "r1") == (1, 0)
    assert sinks.read_gold_quarantine(spark, f"{tmp_root}/gold/quarantine").count() == 0


def test_freshness_of_gold_by_files_then_runs(spark, tmp_root):
    from datetime import datetime, timedelta, timezone

    from tidemark.operators import observe as O
    from tidemark.operators.runs import run_record

    now = datetime.now(tz=timezone.utc)
    assert O.gold_freshness(spark, tmp_root, now).first()["source"] == "none"
    done = now - timedelta(hours=30)
    sinks.append_runs(run_record(spark, "r", "succeeded", done, "gold", "gold", done), f"{tmp_root}/runs")
    row = O.gold_freshness(spark, tmp_root, now).first()
    assert (row["source"], row["age_hours"], row["status"]) == ("runs", 30.0, "breached")
    schema = "dt STRING, event_type STRING, events BIGINT, amount_usd DOUBLE"
    sinks.write_gold(spark.createDataFrame([("2026-01-02", "purchase", 1, 1.0)], schema), f"{tmp_root}/gold/metrics")
    row = O.gold_freshness(spark, tmp_root, now + timedelta(hours=1)).first()
    assert (row["source"], row["status"]) == ("gold", "ok") and 0.9 < row["age_hours"] <= 1.0


def test_window_rebuilds_whole_partitions_at_the_edge_of_an_offset(spark, tmp_root, bronze, event):
    from tidemark.operators import cleanse as C
    from tidemark.operators import late as L

    rows = bronze(
        event(event_id="in", event_ts="2026-01-10T23:30:00+14:00"),  # 09:30 UTC of the day, dt of the day
        event(event_id="edge", event_ts="2026-01-11T05:00:00+14:00"),  # 15:00 UTC of the 10th, dt the 11th
        event(event_id="after", event_ts="2026-01-11T20:00:00+00:00"),  # the 11th in both
        event(event_id="west", event_ts="2026-01-09T20:00:00-12:00"),  # 08:00 UTC of the 10th, dt the 9th
        event(event_id="far", event_ts="2026-01-07T00:00:00+00:00"),
    )
    silver = C.accepted(C.cleanse(rows, "2026-01-20T00:00:00Z")).select(*sinks.SILVER_SCHEMA.names)
    sinks.write_partitions(silver, f"{tmp_root}/silver", ("event_type", "dt"))
    rebuilt = L.rebuild_window(sinks.read_silver(spark, f"{tmp_root}/silver"), "2026-01-10", 0)
    assert {r["dt"]: r["events"] for r in rebuilt.collect()} == {"2026-01-09": 1, "2026-01-10": 1, "2026-01-11": 2}
    plan = rebuilt._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "2026-01-09" in plan and "2026-01-11" in plan


def test_gold_prunes_the_silver_that_a_join_reads(spark, tmp_root, landed):
    from tidemark.operators import cleanse as C
    from tidemark.operators.gold import daily_metrics
    from tidemark.plans import kpis

    rows = C.accepted(C.cleanse(landed, "2026-01-03T00:00:00Z")).select(*sinks.SILVER_SCHEMA.names)
    sinks.write_partitions(rows, f"{tmp_root}/silver", ("event_type", "dt"))
    silver = sinks.read_silver(spark, f"{tmp_root}/silver")
    sinks.write_gold(daily_metrics(silver, ordered=False), f"{tmp_root}/gold")
    gold = sinks.read_gold(spark, f"{tmp_root}/gold").withColumnRenamed("metric", "event_type").filter("amount_usd > 10")
    joined = kpis.events_with_daily_metric(silver, gold)
    assert joined.count() == 4
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "parse_json" not in plan
