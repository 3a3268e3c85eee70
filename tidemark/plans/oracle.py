"""Shared SQL of the reference results, written for a plain SQL engine.

`ORACLE_CTES` states the same derived Bronze, cleansed, Silver and Gold rows as
`plans.feed`, straight from the columns of `events`.
"""

from __future__ import annotations

import re

ORACLE_CTES = """
bronze AS (
  SELECT event_id AS n, ts,
         CASE WHEN event_id % 113 = 0 OR event_id % 97 = 0 THEN ''
              ELSE 'evt-' || lpad(CAST(event_id AS VARCHAR), 8, '0') END AS event_id,
         event_id % 113 = 0 AS is_empty,
         event_id % 107 = 0 AS bad_ts,
         event_id % 101 = 0 AS bad_qty,
         CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart'
                         WHEN 'signup' THEN 'refund' ELSE event_type END AS event_type,
         CASE WHEN event_id % 109 = 0 THEN ''
              ELSE 'user-' || lpad(CAST(user_id AS VARCHAR), 4, '0') END AS user_id,
         'SKU-' || CAST((event_id % 4 + 1) * 100 AS VARCHAR) AS sku,
         CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 6 AS BIGINT) AS quantity,
         CASE WHEN event_id % 103 = 0 THEN -value ELSE value END AS amount_usd,
         list_extract(['US', 'DE', 'IN', 'BR', 'JP'], CAST(user_id % 5 + 1 AS INTEGER)) AS country,
         'events/dt=' || strftime(ts, '%Y-%m-%d') || '/evt-' || lpad(CAST(event_id AS VARCHAR), 8, '0') || '.json' AS source_key
  FROM events
),
cleansed AS (
  SELECT *,
         CASE WHEN is_empty THEN 'empty_record'
              WHEN event_id = '' THEN 'missing_event_id'
              WHEN event_type NOT IN ('page_view', 'add_to_cart', 'purchase', 'refund') THEN 'unknown_event_type'
              WHEN bad_qty THEN 'non_numeric_measures'
              WHEN quantity <= 0 THEN 'non_positive_quantity'
              WHEN amount_usd < 0 THEN 'negative_amount'
              WHEN bad_ts THEN 'schema_invalid' END AS reason,
         concat_ws('+',
              CASE WHEN is_empty OR event_id = '' THEN 'event_id_present' END,
              CASE WHEN is_empty OR event_type NOT IN ('page_view', 'add_to_cart', 'purchase', 'refund')
                   THEN 'known_event_type' END,
              CASE WHEN is_empty OR user_id = '' THEN 'required_dimensions' END,
              CASE WHEN is_empty OR bad_qty OR quantity <= 0 OR amount_usd < 0
                   THEN 'quantity_and_amount_sane' END,
              CASE WHEN is_empty OR bad_qty OR bad_ts OR amount_usd < 0 THEN 'schema_valid' END) AS checks,
         date_trunc('second', ts) AS event_ts,
         strftime(ts, '%Y-%m-%d') AS dt,
         date_trunc('second', ts) < TIMESTAMP '2024-01-14 00:00:00' AS _late
  FROM bronze
),
silver AS (
  SELECT n, ts, event_id, event_ts, event_type, user_id, sku, quantity, amount_usd, country, dt, _late
  FROM cleansed WHERE reason IS NULL
),
gold AS (
  SELECT dt, event_type, count(*) AS events, round(sum(amount_usd), 2) AS amount_usd
  FROM silver GROUP BY dt, event_type
)
"""


def with_ctes(select: str, more: str = "") -> str:
    """A full query: the shared definitions, more of them, then the select."""
    extra = f",\n{more}" if more else ""
    return f"WITH {ORACLE_CTES.strip()}{extra}\n{select.strip()}"


def whole_numbers(sql: str) -> str:
    """The SQL with padded numbers kept whole, as in the feed: lpad alone cuts those that are longer."""
    return re.sub(
        r"lpad\((CAST\(\w+ AS VARCHAR\)), (\d+), '0'\)",
        r"lpad(\1, CAST(greatest(length(\1), \2) AS INTEGER), '0')",
        sql,
    )
