"""Queries that differed from their SQL on larger tables, on rows that show it."""

from __future__ import annotations

import pytest

from tidemark.plans import registry

#: Numbers longer than their padding, and a zero with a sign.
ROWS = """(103, TIMESTAMP '2024-01-01 00:00:11.17', 235, 'purchase', 0.0, '{"k": 76}'),
          (206, TIMESTAMP '2024-01-02 00:00:11.17', 15000, 'view', 0.01, '{"k": 76}'),
          (1000001, TIMESTAMP '2024-01-02 07:00:11.17', 7, 'click', 3.5, '{"k": 75}'),
          (123456789, TIMESTAMP '2024-01-03 00:00:11.17', 89999, 'signup', 12.25, '{"k": 76}')"""


@pytest.mark.parametrize("name", ["seed_events", "silver_conform", "encode_decode"])
def test_query_equals_its_sql_on_large_keys(spark, tmp_root, name):
    con = pytest.importorskip("duckdb").connect()
    con.execute(
        f"""CREATE TABLE events AS SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type,
            value::DOUBLE AS value, props FROM (VALUES {ROWS}) AS t(event_id, ts, user_id, event_type, value, props)"""
    )
    con.execute(f"COPY events TO '{tmp_root}/events.parquet' (FORMAT parquet)")
    frame = registry.queries()[name](spark, tmp_root)
    result = con.execute(registry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted((tuple(row) for row in result.fetchall()), key=repr)
    # By their spelling: a zero with a sign equals one without.
    assert [repr(row) for row in sorted((tuple(row) for row in frame.select(*names).collect()), key=repr)] == [repr(r) for r in want]
