"""The registered queries: complete, and equal to their SQL on the small data set."""

from __future__ import annotations

import os

import pytest

from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"
CHECKED = (
    "gold_daily", "quality_checks", "gold_reject", "run_keys", "manifest_keys", "path_ratios", "notification_refs",
    "run_completion", "run_lookup", "trigger_settings", "key_parts", "names_drift", "quarantine_sink", "gold_rejects_merged",
    "zone_partitions", "seeded_zone", "closed_batch", "reprocess_window", "reprocess_offsets", "busy_day_events",
    "late_refunds", "freshness_sources", "stream_produce",
)


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not present")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    frame = registry.queries()[name](spark, DATA)
    result = con.execute(registry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted((tuple(row) for row in result.fetchall()), key=repr)
    got = sorted((tuple(row) for row in frame.select(*names).collect()), key=repr)
    assert got == want and got
