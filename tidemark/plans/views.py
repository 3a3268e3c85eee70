"""Named analytical queries and marts over the zone tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.schemas import EVENT_TYPE_LABELS

GOLD_VIEW = "daily_event_metrics"
SILVER_VIEW = "commerce_event_conformed"

_LABEL_CASES = " ".join(f"WHEN '{name}' THEN '{label}'" for name, label in EVENT_TYPE_LABELS.items())

# Named queries; `as_of` is a parameter so a result can be reproduced.
NAMED_QUERIES = {
    "gold_daily_totals": f"""
        SELECT metric, dt, events, amount_usd FROM {GOLD_VIEW} ORDER BY dt, metric""",
    "gold_purchase_revenue": f"""
        SELECT dt, events, amount_usd FROM {GOLD_VIEW} WHERE metric = 'purchase' ORDER BY dt""",
    "gold_last_7_days": f"""
        SELECT metric, dt, events, amount_usd FROM {GOLD_VIEW}
        WHERE dt >= date_format(date_sub(coalesce(CAST(:as_of AS DATE), current_date()), 6), 'yyyy-MM-dd')
        ORDER BY dt, metric""",
    "silver_late_event_counts": f"""
        SELECT event_type, dt, count(*) AS events, count_if(_late) AS late_events
        FROM {SILVER_VIEW} GROUP BY event_type, dt ORDER BY dt, event_type""",
}

# Marts, in dependency order.
MARTS = {
    "stg_daily_event_metrics": f"""
        SELECT metric AS event_type, dt, events, amount_usd FROM {GOLD_VIEW}""",
    "fct_daily_event_metrics": """
        SELECT event_type, dt, events, amount_usd FROM stg_daily_event_metrics""",
    "fct_daily_purchase_revenue": """
        SELECT dt, events, amount_usd AS gmv_usd FROM stg_daily_event_metrics WHERE event_type = 'purchase'""",
    "dim_event_type": f"""
        SELECT DISTINCT event_type, CASE event_type {_LABEL_CASES} END AS event_type_name FROM stg_daily_event_metrics""",
}


def create_views(spark: SparkSession, gold: DataFrame | None = None, silver: DataFrame | None = None) -> None:
    """Expose zone frames under their table names, and the marts over Gold.

    ``gold`` has a `metric` column, as the stored table does.
    """
    if silver is not None:
        silver.createOrReplaceTempView(SILVER_VIEW)
    if gold is not None:
        gold.createOrReplaceTempView(GOLD_VIEW)
        for name, text in MARTS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {text}")


def run_named(spark: SparkSession, name: str, as_of: str | None = None) -> DataFrame:
    """Result of a named query or mart; an unknown name lists the known ones."""
    if name in MARTS:
        return spark.table(name)
    if name not in NAMED_QUERIES:
        raise KeyError(f"no view is called {name}; there are {sorted([*NAMED_QUERIES, *MARTS])}")
    text = NAMED_QUERIES[name]
    return spark.sql(text, args={"as_of": as_of}) if ":as_of" in text else spark.sql(text)
