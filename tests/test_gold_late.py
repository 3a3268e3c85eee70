from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import days as D
from tidemark.operators import cleanse as C
from tidemark.operators import gold as G
from tidemark.operators import late as L


def silver(bronze, event, rows, watermark="2026-01-10T00:00:00Z"):
    records = [event(event_id=f"e{i}", event_ts=ts, event_type=t, amount_usd=a) for i, (ts, t, a) in enumerate(rows)]
    return C.accepted(C.cleanse(bronze(*records), watermark, 2))


def test_daily_metrics(bronze, event):
    rows = silver(bronze, event, [
        ("2026-01-01T01:00:00Z", "purchase", 10.0),
        ("2026-01-01T02:00:00Z", "purchase", 2.25),
        ("2026-01-01T03:00:00Z", "refund", 1.0),
        ("2026-01-02T00:00:00Z", "purchase", 5.0),
    ])
    got = [tuple(r) for r in G.daily_metrics(rows).collect()]
    assert got == [
        ("2026-01-01", "purchase", 2, 12.25), ("2026-01-01", "refund", 1, 1.0), ("2026-01-02", "purchase", 1, 5.0),
    ]


def test_daily_metrics_of_nothing(bronze, event):
    assert G.daily_metrics(silver(bronze, event, []).filter("false")).count() == 0


def test_metric_faults(spark):
    rows = spark.createDataFrame(
        [("2026-01-02", "purchase", "2", 10.0), ("", "ghost", "0", -4.0), ("2026-01-03", "page_view", "x", 1.0),
         (None, None, None, None), ("2026-01-04", "refund", "1", 0.0)],
        "dt STRING, event_type STRING, events STRING, amount_usd DOUBLE",
    )
    checked = G.with_metric_faults(rows)
    assert sorted(r["dt"] for r in G.accepted_metrics(checked).collect()) == ["2026-01-02", "2026-01-04"]
    reasons = {r["reason"] for r in G.rejected_metrics(checked).collect()}
    assert reasons == {
        "missing_dt+unknown_event_type+non_positive_events+negative_amount",
        "non_numeric_measures",
        "missing_dt+unknown_event_type+non_numeric_measures",
    }


def test_merge_metrics(spark):
    parts = spark.createDataFrame(
        [("purchase", "2026-01-02", 2, 10.5), ("purchase", "2026-01-02", 3, 4.5)],
        "event_type STRING, dt STRING, events BIGINT, amount_usd DOUBLE",
    )
    assert tuple(G.merge_metrics(parts).first()) == ("purchase", "2026-01-02", 5, 15.0, 2)


def test_quarantine_rows_join_both_kinds(spark, bronze, event):
    bad = C.inspect(bronze(event(user_id=None)), keep=("raw", "source_key"))
    metrics = spark.createDataFrame([("", "ghost", 0, -4.0)], "dt STRING, event_type STRING, events BIGINT, amount_usd DOUBLE")
    rows = G.quarantine_rows(G.unreadable(bad), G.rejected_metrics(G.with_metric_faults(metrics))).collect()
    assert {(r["reason"], r["metric"], r["dt"], r["zone"]) for r in rows} == {
        ("unreadable_silver", "unknown", "unknown", "gold"),
        ("missing_dt+unknown_event_type+non_positive_events+negative_amount", "ghost", "unknown", "gold"),
    }


def test_window_bounds():
    assert D.window_bounds("2026-01-10", 2) == (date(2026, 1, 8), date(2026, 1, 10))
    assert D.window_bounds("2026-01-10T23:30:00-05:00", 0) == (date(2026, 1, 11), date(2026, 1, 11))


def test_lookback_setting(spark):
    rows = spark.createDataFrame([("3",), ("0",), ("-1",), ("junk",), (None,), ("",)], "v STRING")
    assert [r[0] for r in rows.select(D.lookback_setting(F.col("v"))).collect()] == [3, 0, 2, 2, 2, 2]


def test_watermark_setting(spark):
    rows = spark.createDataFrame([(None, "2026-01-02T00:00:00Z"), ("", ""), ("nope", None)], "w STRING, a STRING")
    got = rows.select(F.date_format(D.watermark_setting(F.col("w"), F.col("a")), "yyyy-MM-dd").alias("d")).collect()
    assert [r["d"] for r in got] == ["2026-01-02", None, None]


def test_rebuild_window(bronze, event):
    rows = silver(bronze, event, [
        ("2026-01-09T01:00:00Z", "purchase", 4.0), ("2026-01-08T01:00:00Z", "purchase", 6.0),
        ("2026-01-01T01:00:00Z", "purchase", 99.0),
    ], watermark="2026-01-10T12:00:00Z")
    rebuilt = [(r["dt"], r["amount_usd"]) for r in L.rebuild_window(rows, "2026-01-10", 2).collect()]
    assert rebuilt == [("2026-01-08", 6.0), ("2026-01-09", 4.0)]
    report = L.window_report(rows, "2026-01-10", 2).first()
    assert (report["silver_in_window"], report["late_flagged"]) == (2, 1)


def test_affected_partitions_use_utc(bronze, event):
    rows = silver(bronze, event, [("2026-01-01T23:30:00-05:00", "refund", 1.0), ("2026-01-02T01:00:00Z", "refund", 1.0)])
    assert [tuple(r) for r in L.affected_partitions(rows).collect()] == [("refund", "2026-01-02")]


def test_keys_in_window(spark):
    keys = spark.createDataFrame(
        [("events/dt=2026-01-08/a.json",), ("events/dt=2026-01-11/a.json",), ("events/a.json",), ("dt=2026-13-40/a",)], "key STRING"
    )
    kept = L.keys_in_window(keys, date(2026, 1, 8), date(2026, 1, 10)).collect()
    assert [r["key"] for r in kept] == ["events/dt=2026-01-08/a.json"]


@pytest.mark.parametrize("lookback", [0, 2])
def test_window_filter_prunes_partitions(spark, bronze, event, tmp_root, lookback):
    from tidemark.sources import sinks

    rows = silver(bronze, event, [("2026-01-0%dT01:00:00Z" % d, "purchase", 1.0) for d in range(1, 10)])
    sinks.write_silver(rows, f"{tmp_root}/silver")
    stored = sinks.read_silver(spark, f"{tmp_root}/silver")
    window = L.partitions_in_window(stored, *D.window_bounds("2026-01-09", lookback))
    assert window.count() == lookback + 1
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
