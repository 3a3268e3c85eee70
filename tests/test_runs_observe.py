from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import observe as O
from tidemark.operators import runs as R
from tidemark.schemas import RUN_SCHEMA

T0 = datetime(2026, 1, 2, tzinfo=timezone.utc)


def points(spark, zone, metrics, started=None, finished=None, latest=None, status="succeeded"):
    rows = [("r", zone, status, started, finished, latest, json.dumps(metrics))]
    schema = "run_id STRING, zone STRING, status STRING, started_at TIMESTAMP, finished_at TIMESTAMP, latest_event_ts TIMESTAMP, metrics STRING"
    return {r["name"]: r["value"] for r in R.metric_points(spark.createDataFrame(rows, schema)).collect()}


def test_silver_points(spark):
    finished = T0.replace(microsecond=40000)
    got = points(spark, "silver", {"valid": 10, "quarantined": 2, "late": 1, "silver_written": 10}, T0, finished)
    assert got == {
        "RecordsProcessed": 10, "QualityFailures": 2, "LateEvents": 1, "ObjectsWritten": 10,
        "EstimatedBytes": 20480, "RunDurationMilliseconds": 40.0,
    }


def test_gold_points_and_lag(spark):
    got = points(spark, "gold", {"silver_read": 3, "gold_written": 2}, None, T0, datetime(2026, 1, 1, tzinfo=timezone.utc))
    assert got["PipelineLagSeconds"] == 86400.0
    assert got["EstimatedBytes"] == 3 * 2048 + 2 * 8192
    assert "QualityFailures" not in got and "RunDurationMilliseconds" not in got


def test_quality_points(spark):
    assert points(spark, "quality", {"rows_scanned": 4, "rows_failed": 1})["QualityFailRatio"] == 0.25
    assert points(spark, "quality", {"rows_scanned": 4, "rows_failed": 1, "fail_ratio": 0.5})["QualityFailRatio"] == 0.5
    assert points(spark, "quality", {"rows_scanned": 4, "fail_ratio": True})["QualityFailRatio"] == 0.0
    assert points(spark, "quality", {})["QualityFailRatio"] == 0.0


def test_counters_read_loosely(spark):
    assert points(spark, "bronze", {"valid": True, "rows_scanned": [1, 2, 3]})["RecordsProcessed"] == 3
    assert points(spark, "bronze", {"valid": "x", "silver_read": 2.9})["RecordsProcessed"] == 2
    assert points(spark, "bronze", {"records": "7"})["RecordsProcessed"] == 7
    assert points(spark, "bronze", {"valid": None, "records": 4})["RecordsProcessed"] == 4


def test_lag_is_never_negative(spark):
    got = points(spark, "gold", {}, None, T0, datetime(2026, 1, 3, tzinfo=timezone.utc))
    assert got["PipelineLagSeconds"] == 0.0


def test_versions_limit_and_lookup(spark):
    rows = [("a", "running", 1), ("a", "succeeded", 2), ("b", "failed", 3)]
    log = spark.createDataFrame(rows, "run_id STRING, status STRING, s INT").withColumn("started_at", F.timestamp_seconds("s"))
    latest = R.latest_versions(log)
    assert {(r["run_id"], r["status"]) for r in latest.collect()} == {("a", "succeeded"), ("b", "failed")}
    assert [r["run_id"] for r in R.latest_runs(latest, 1).collect()] == ["b"]
    assert R.find_run(latest, "a").first()["status"] == "succeeded"


def test_complete_merges_counters(spark):
    run = R.run_record(spark, "r", "running", T0, zone="silver", step="reprocess", metrics='{"a":1,"b":2}')
    done = R.complete(run, "succeeded", T0, metrics=F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4")))
    row = done.first()
    assert row["status"] == "succeeded" and json.loads(row["metrics"]) == {"a": "1", "b": "3", "c": "4"}
    assert {(r["name"], r["value"]) for r in R.counters(done).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


def test_record_round_trip(spark):
    quality = [{"check_name": "c", "passed": True, "rows_scanned": 1, "rows_failed": 0, "detail": ""}]
    run = R.run_record(spark, "r", "succeeded", T0, zone="other", objects='["k1","k2"]', quality=json.dumps(quality), metrics="junk")
    row = R.decode(run).first()
    assert row["objects"] == ["k1", "k2"] and row["quality"][0]["check_name"] == "c"
    assert row["zone"] is None and not row["metrics"]
    with pytest.raises(ValueError):
        R.run_record(spark, "r", "odd", T0)
    assert run.schema == RUN_SCHEMA


@pytest.mark.parametrize(
    "found,missing,passed,action,want",
    [(0, 2, True, "pass", "failed"), (1, 2, True, "pass", "succeeded"), (0, 0, True, "pass", "succeeded"),
     (1, 0, False, "fail", "quality_failed"), (1, 0, False, "quarantine", "succeeded")],
)
def test_step_outcome(spark, found, missing, passed, action, want):
    row = spark.createDataFrame([(found, missing, passed, action)], "f INT, m INT, p BOOLEAN, a STRING")
    assert row.select(R.step_outcome(F.col("f"), F.col("m"), F.col("p"), F.col("a"))).first()[0] == want


@pytest.mark.parametrize("hours,status", [(23, "ok"), (24, "ok"), (25, "breached")])
def test_freshness(spark, hours, status):
    written = spark.range(1).select(F.expr(f"TIMESTAMP '2026-01-03 00:00:00' - INTERVAL {hours} HOUR").alias("last_written"))
    row = O.freshness(written, "2026-01-03T00:00:00Z").first()
    assert (row["age_hours"], row["status"], row["ok"]) == (float(hours), status, status == "ok")


def test_last_gold_write_prefers_objects(spark):
    objects = spark.createDataFrame([(datetime(2026, 1, 1, 5),)], "modificationTime TIMESTAMP")
    runs = spark.createDataFrame(
        [("succeeded", datetime(2026, 1, 2), None), ("failed", datetime(2026, 1, 9), datetime(2026, 1, 9))],
        "status STRING, started_at TIMESTAMP, finished_at TIMESTAMP",
    )
    show = F.date_format("last_written", "yyyy-MM-dd").alias("d")
    assert O.last_gold_write(objects, runs).select(show).first()["d"] == "2026-01-01"
    assert O.last_gold_write(objects.filter("false"), runs).select(show).first()["d"] == "2026-01-02"


COUNTS = {"bronze": 20, "silver": 18, "silver_quarantine": 3, "quality": 1, "gold": 1, "gold_quarantine": 2, "runs": 1}


def graph(spark, **changes):
    values = {**COUNTS, **changes}
    counts = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} BIGINT" for k in values))
    nodes = O.nodes_from_counts(counts)
    return nodes, O.edge_weights(nodes, O.edge_table(spark))


def test_lineage_numbers(spark):
    nodes, edges = graph(spark)
    assert nodes.count() == 7 and edges.count() == 13
    got = {(r["cut"], r["path"]): (r["weight"], r["ratio"]) for r in O.path_ratios(edges).collect()}
    assert got[("family", "cleanse")] == (20, 0.6667)
    assert got[("family", "reject")][0] == 7 and got[("family", "quarantine")][0] == 3
    assert got[("bronze_split", "cleanse")][1] == 0.8571 and got[("bronze_split", "reject")][1] == 0.1429
    assert got[("quality_split", "aggregate")][1] == 0.1667 and got[("quality_split", "reject")][1] == 0.3333


def test_ratio_alert(spark):
    ratios = O.path_ratios(graph(spark)[1])
    row = O.ratio_alert(ratios).first()
    assert row["ok"] and row["status"] == "ok"
    assert not O.ratio_alert(ratios, cleanse_floor=0.7).first()["family_ok"]
    assert not O.ratio_alert(ratios, bronze_cleanse_floor=0.9).first()["bronze_ok"]
    assert not O.ratio_alert(ratios, quality_aggregate_floor=0.2).first()["ok"]
    assert not O.ratio_alert(ratios, quality_reject_ceiling=0.3).first()["quality_ok"]


def test_empty_graph_passes(spark):
    ratios = O.path_ratios(graph(spark, **{k: 0 for k in COUNTS})[1])
    assert {r["ratio"] for r in ratios.collect()} == {0.0}
    assert O.ratio_alert(ratios).first()["ok"]


def test_unknown_count_stays_null(spark):
    _, edges = graph(spark, gold=None)
    assert edges.filter("dst = 'gold'").first()["weight"] is None


def test_quarantine_subgraph(spark):
    row = O.subgraph_totals(O.quarantine_subgraph(*graph(spark))).first()
    assert tuple(row) == (5, 10, 2)
