"""The registered queries over zones, with their expected results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import days as D
from tidemark.functions import keys as K
from tidemark.operators import cleanse as C
from tidemark.operators import contracts as CT
from tidemark.operators import gold as G
from tidemark.operators import identity as I
from tidemark.operators import late as L
from tidemark.operators import partitions as PT
from tidemark.operators import quality as Q
from tidemark.plans import feed, flow, kpis, views
from tidemark.plans.oracle import whole_numbers, with_ctes
from tidemark.schemas import BRONZE_CONTRACT, EVENT_TYPES, SILVER_SCHEMA
from tidemark.session import configure, materialize, scratch_path
from tidemark.sources import sinks

Report = Callable[[SparkSession, str], DataFrame]
REPORTS: dict[str, Report] = {}
ORACLES: dict[str, str] = {}


def report(name: str, sql: str | None = None, more: str = "", raw_sql: bool = False):
    """Register a query under a name, with the SQL that gives the same rows."""

    def register(fn: Report) -> Report:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        REPORTS[name] = run
        if sql is not None:
            ORACLES[name] = sql if raw_sql else with_ctes(sql, more)
        return fn

    return register


def _stamp(column) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# --- cleansing -------------------------------------------------------------


@report("gold_daily", "SELECT dt, event_type, events, amount_usd FROM gold")
def gold_daily(spark, sf):
    return G.daily_metrics(feed.silver(spark, sf))


@report(
    "silver_cleanse",
    """SELECT source_key, CASE WHEN reason IS NOT NULL THEN 'quarantined' WHEN _late THEN 'late' ELSE 'valid' END AS outcome,
              coalesce(reason, '') AS reason FROM cleansed""",
)
def silver_cleanse(spark, sf):
    outcome = F.when(F.col("reason").isNotNull(), "quarantined").when(F.col("_late"), "late").otherwise("valid")
    return feed.cleansed(spark, sf, ("source_key",)).select(
        "source_key", outcome.alias("outcome"), F.coalesce("reason", F.lit("")).alias("reason")
    )


@report(
    "silver_quarantine_by_reason",
    "SELECT reason, count(*) AS records FROM cleansed WHERE reason IS NOT NULL GROUP BY reason",
)
def silver_quarantine_by_reason(spark, sf):
    bad = C.quarantined(feed.cleansed(spark, sf))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


@report(
    "silver_conform",
    whole_numbers(
        with_ctes(
            """SELECT event_id, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, event_type, user_id, sku, quantity,
              amount_usd + 0.0 AS amount_usd, country, dt FROM silver"""
        )
    ),
    raw_sql=True,
)
def silver_conform(spark, sf):
    """Conformed rows. A JSON number is read as a decimal, so a zero amount has no sign."""
    rows = feed.silver(spark, sf)
    return rows.select(
        "event_id", _stamp("event_ts").alias("event_ts"), "event_type", "user_id", "sku", "quantity", "amount_usd",
        "country", "dt",
    )


@report("late_flag", "SELECT event_id, event_type, dt, _late AS late FROM silver")
def late_flag(spark, sf):
    return feed.silver(spark, sf).select("event_id", "event_type", "dt", F.col("_late").alias("late"))


@report(
    "quarantine_keys",
    """SELECT 'quarantine/reason=' || reason || '/' ||
              CASE WHEN event_id = '' THEN 'unknown' ELSE event_id END || '.json' AS key,
              reason, CASE WHEN event_id = '' THEN 'unknown' ELSE event_id END AS event_id
       FROM cleansed WHERE reason IS NOT NULL""",
)
def quarantine_keys(spark, sf):
    bad = C.quarantined(feed.cleansed(spark, sf))
    keyed = bad.select(K.silver_quarantine_key(F.col("reason"), F.col("event_id")).alias("key"))
    return keyed.select(
        "key",
        K.hive_value(F.col("key"), "reason").alias("reason"),
        K.quarantine_event_id(F.col("key")).alias("event_id"),
    )


# --- quality gate ----------------------------------------------------------


@report(
    "quality_checks",
    """SELECT check_name, rows_failed = 0 AS passed, rows_scanned, rows_failed
       FROM (SELECT c.check_name, (SELECT count(*) FROM cleansed) AS rows_scanned,
                    (SELECT count(*) FROM cleansed WHERE contains('+' || checks || '+', '+' || c.check_name || '+'))
                      AS rows_failed
             FROM (VALUES ('event_id_present'), ('known_event_type'), ('required_dimensions'),
                          ('quantity_and_amount_sane'), ('schema_valid')) AS c(check_name)) AS t""",
)
def quality_checks(spark, sf):
    tallied = Q.tally(C.inspect(feed.bronze(spark, sf), keep=()))
    return Q.check_results(tallied).drop("detail")


QUALITY_TALLY_SQL = """tally AS (
  SELECT count(*) AS rows_scanned,
         count(*) FILTER (WHERE user_id = '') AS rows_failed,
         CAST(0 AS BIGINT) AS event_id_present, CAST(0 AS BIGINT) AS known_event_type,
         count(*) FILTER (WHERE user_id = '') AS required_dimensions,
         CAST(0 AS BIGINT) AS quantity_and_amount_sane, CAST(0 AS BIGINT) AS schema_valid
  FROM silver)"""


@report(
    "quality_decision",
    """SELECT rows_failed = 0 AS passed, CASE WHEN rows_failed > 0 THEN 'quarantine' ELSE 'pass' END AS action,
              rows_scanned, rows_failed, round(rows_failed / rows_scanned, 4) AS fail_ratio,
              CASE WHEN rows_failed > 0 THEN 'required_dimensions' ELSE '' END AS failed_checks,
              event_id_present, known_event_type, required_dimensions, quantity_and_amount_sane, schema_valid FROM tally""",
    QUALITY_TALLY_SQL,
)
def quality_decision(spark, sf):
    return Q.decide(Q.tally(Q.with_checks(feed.silver(spark, sf))), "quarantine", 0.0)


@report(
    "quality_gate_tolerant",
    """SELECT true AS passed, 'pass' AS action, rows_scanned, rows_failed,
              round(rows_failed / rows_scanned, 4) AS fail_ratio FROM tally""",
    QUALITY_TALLY_SQL,
)
def quality_gate_tolerant(spark, sf):
    decided = Q.decide(Q.tally(Q.with_checks(feed.silver(spark, sf))), "fail", 0.2)
    return decided.select("passed", "action", "rows_scanned", "rows_failed", "fail_ratio")


@report("quality_failing_rows", "SELECT source_key, checks AS reason FROM cleansed WHERE checks <> ''")
def quality_failing_rows(spark, sf):
    checked = C.inspect(feed.bronze(spark, sf), keep=("source_key",))
    return Q.failing(checked).select("source_key", "reason")


@report(
    "clean_subset_gold",
    """SELECT dt, event_type, count(*) AS events, round(sum(amount_usd), 2) AS amount_usd
       FROM silver WHERE user_id <> '' GROUP BY dt, event_type""",
)
def clean_subset_gold(spark, sf):
    return G.daily_metrics(Q.passing(Q.with_checks(feed.silver(spark, sf))))


# --- gold ------------------------------------------------------------------


def _posted_metrics(spark, sf):
    """Daily metrics of all typed rows, with faults by day of the month."""
    rows = C.inspect(feed.bronze(spark, sf), keep=(), gate=False)
    rows = rows.filter(F.col("event_type").isNotNull() & F.col("amount_usd").isNotNull() & F.col("event_ts").isNotNull())
    by_day = G.daily_metrics(rows, ordered=False)
    day = F.substring("dt", 9, 2).cast("int")
    return by_day.select(
        F.when(day % 7 == 0, "").otherwise(F.col("dt")).alias("dt"),
        F.when((day % 11 == 0) & (F.col("event_type") == "refund"), "ghost").otherwise(F.col("event_type")).alias("event_type"),
        F.when(day % 5 == 0, "x").when(day % 3 == 0, "0").otherwise(F.col("events").cast("string")).alias("events"),
        F.when(day % 4 == 0, -F.col("amount_usd")).otherwise(F.col("amount_usd")).alias("amount_usd"),
    )


POSTED_SQL = """posted0 AS (
  SELECT dt, event_type, count(*) AS events, round(sum(amount_usd), 2) AS amount_usd
  FROM cleansed WHERE NOT is_empty AND NOT bad_ts GROUP BY dt, event_type),
posted AS (
  SELECT CASE WHEN d % 7 = 0 THEN '' ELSE dt END AS dt,
         CASE WHEN d % 11 = 0 AND event_type = 'refund' THEN 'ghost' ELSE event_type END AS event_type,
         CASE WHEN d % 5 = 0 THEN 'x' WHEN d % 3 = 0 THEN '0' ELSE CAST(events AS VARCHAR) END AS events,
         CASE WHEN d % 4 = 0 THEN -amount_usd ELSE amount_usd END AS amount_usd
  FROM (SELECT *, CAST(substr(dt, 9, 2) AS INTEGER) AS d FROM posted0) AS p),
judged AS (
  SELECT *, concat_ws('+',
      CASE WHEN dt = '' THEN 'missing_dt' END,
      CASE WHEN event_type NOT IN ('page_view', 'add_to_cart', 'purchase', 'refund') THEN 'unknown_event_type' END,
      CASE WHEN events = 'x' THEN 'non_numeric_measures' END,
      CASE WHEN events <> 'x' AND try_cast(events AS BIGINT) <= 0 THEN 'non_positive_events' END,
      CASE WHEN events <> 'x' AND amount_usd < 0 THEN 'negative_amount' END) AS reason
  FROM posted)"""


@report("gold_reject", "SELECT reason, dt, event_type, events, amount_usd FROM judged WHERE reason <> ''", POSTED_SQL)
def gold_reject(spark, sf):
    return G.rejected_metrics(G.with_metric_faults(_posted_metrics(spark, sf)))


@report("gold_accept", "SELECT dt, event_type, events, amount_usd FROM judged WHERE reason = ''", POSTED_SQL)
def gold_accept(spark, sf):
    return G.accepted_metrics(G.with_metric_faults(_posted_metrics(spark, sf)))


@report(
    "unreadable_silver",
    "SELECT 'unreadable_silver' AS reason, source_key FROM cleansed WHERE contains(checks, 'schema_valid')",
)
def unreadable_silver(spark, sf):
    inspected = C.inspect(feed.bronze(spark, sf), keep=("raw", "source_key"))
    return G.unreadable(inspected).select("reason", "source_key")


@report(
    "gold_quarantine",
    """SELECT reason, metric, dt, count(*) AS records,
              'quarantine/reason=' || reason || '/metric=' || metric || '/dt=' || dt || '/part-000.json' AS key
       FROM (SELECT reason, event_type AS metric, CASE WHEN dt = '' THEN 'unknown' ELSE dt END AS dt FROM judged WHERE reason <> ''
             UNION ALL
             SELECT 'unreadable_silver', 'unknown', 'unknown' FROM cleansed WHERE contains(checks, 'schema_valid')) AS t
       GROUP BY reason, metric, dt""",
    POSTED_SQL,
)
def gold_quarantine(spark, sf):
    rejected = G.rejected_metrics(G.with_metric_faults(_posted_metrics(spark, sf)))
    inspected = C.inspect(feed.bronze(spark, sf), keep=("raw", "source_key"))
    rows = G.quarantine_rows(G.unreadable(inspected), rejected)
    counted = rows.groupBy("reason", "metric", "dt").agg(F.count(F.lit(1)).alias("records"))
    return counted.withColumn("key", K.gold_quarantine_key(F.col("reason"), F.col("metric"), F.col("dt")))


@report("gold_mirror", "SELECT event_type || '#' || dt AS metric_day, event_type, dt, events, amount_usd FROM gold")
def gold_mirror(spark, sf):
    return G.serving_rows(G.daily_metrics(feed.silver(spark, sf), ordered=False))


@report(
    "merge_metrics",
    """SELECT event_type, dt, CAST(sum(events) AS BIGINT) AS events, round(sum(amount_usd), 4) AS amount_usd,
              count(*) AS compacted_from
       FROM (SELECT event_type, dt, hour(event_ts) AS h, count(*) AS events, round(sum(amount_usd), 2) AS amount_usd
             FROM silver GROUP BY event_type, dt, hour(event_ts)) AS parts
       GROUP BY event_type, dt""",
)
def merge_metrics(spark, sf):
    parts = feed.silver(spark, sf).groupBy("event_type", "dt", F.hour("event_ts").alias("part")).agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("amount_usd"), 2).alias("amount_usd")
    )
    return G.merge_metrics(parts)


# --- lateness --------------------------------------------------------------


@report(
    "window_filter",
    "SELECT event_id, event_type, dt FROM silver WHERE CAST(event_ts AS DATE) BETWEEN DATE '2024-01-28' AND DATE '2024-01-30'",
)
def window_filter(spark, sf):
    start, end = D.window_bounds(feed.AS_OF, feed.LOOKBACK_DAYS)
    return L.events_in_window(feed.silver(spark, sf), start, end).select("event_id", "event_type", "dt")


@report(
    "window_prune",
    """SELECT 'events/event_type=' || event_type || '/dt=' || dt || '/' || event_id || '.json' AS key FROM silver
       WHERE n % 10 <> 0 AND dt BETWEEN '2024-01-28' AND '2024-01-30'""",
)
def window_prune(spark, sf):
    start, end = D.window_bounds(feed.AS_OF, feed.LOOKBACK_DAYS)
    key = K.silver_key(F.col("event_type"), F.col("dt"), F.col("event_id"))
    bare = F.col("event_id").endswith("0")
    keys = feed.silver(spark, sf).select(F.when(bare, F.concat(F.lit("events/"), "event_id")).otherwise(key).alias("key"))
    return L.keys_in_window(keys, start, end)


@report(
    "reprocess_window",
    "SELECT dt, event_type, events, amount_usd FROM gold WHERE dt BETWEEN '2024-01-28' AND '2024-01-30'",
)
def reprocess_window(spark, sf):
    return L.rebuild_window(feed.silver(spark, sf), feed.AS_OF, feed.LOOKBACK_DAYS)


OFFSETS_SQL = """placed AS (
  SELECT event_type, amount_usd, strftime(event_ts + to_hours(n % 27 - 12), '%Y-%m-%d') AS dt,
         CAST(event_ts AS DATE) BETWEEN DATE '2024-01-12' AND DATE '2024-01-14' AS inside
  FROM silver)"""


@report(
    "reprocess_offsets",
    """SELECT dt, event_type, count(*) AS events, round(sum(amount_usd), 2) AS amount_usd
       FROM placed GROUP BY dt, event_type HAVING count(*) FILTER (WHERE inside) > 0""",
    OFFSETS_SQL,
)
def reprocess_offsets(spark, sf):
    """Stored Silver with offsets of -12 to +14 hours: whole partitions rebuilt from a pruned scan."""
    bronze = feed.with_bronze(feed.events(spark, sf), offset="CAST(event_id % 27 - 12 AS INT)")
    path = scratch_path(spark, "silver")
    silver = C.accepted(C.cleanse(bronze, feed.WATERMARK, feed.LOOKBACK_DAYS, keep=("landed_at",)))
    sinks.write_partitions(silver.select(*SILVER_SCHEMA.names), path, ("event_type", "dt"))
    return L.rebuild_window(sinks.read_silver(spark, path), "2024-01-14", feed.LOOKBACK_DAYS)


@report(
    "reprocess_report",
    """SELECT CAST(20 AS BIGINT) AS lookback_days, '2024-01-10' AS window_start, '2024-01-30' AS window_end,
              count(*) AS silver_in_window, count(*) FILTER (WHERE _late) AS late_flagged
       FROM silver WHERE dt BETWEEN '2024-01-10' AND '2024-01-30'""",
)
def reprocess_report(spark, sf):
    row = L.window_report(feed.silver(spark, sf), feed.AS_OF, 20)
    return row.withColumn("lookback_days", F.col("lookback_days").cast("bigint"))


@report("affected_partitions", "SELECT DISTINCT event_type, dt FROM silver WHERE _late")
def affected_partitions(spark, sf):
    return L.affected_partitions(feed.silver(spark, sf).filter("_late"))


@report(
    "late_counts",
    "SELECT event_type, dt, count(*) AS events, count(*) FILTER (WHERE _late) AS late_events FROM silver GROUP BY event_type, dt",
)
def late_counts(spark, sf):
    return L.late_counts(feed.silver(spark, sf))


# --- partitions ------------------------------------------------------------


@report(
    "partition_grid",
    """SELECT t.event_type, strftime(d.day, '%Y-%m-%d') AS dt
       FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS day
             FROM events) AS d,
            (VALUES ('page_view'), ('add_to_cart'), ('purchase'), ('refund')) AS t(event_type)""",
    raw_sql=True,
)
def partition_grid(spark, sf):
    bounds = feed.events(spark, sf).agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end"))
    return PT.grid(bounds, "event_type")


@report("discover_partitions", "SELECT DISTINCT event_type, dt FROM silver")
def discover_partitions(spark, sf):
    rows = feed.silver(spark, sf)
    keys = rows.select(K.silver_key(F.col("event_type"), F.col("dt"), F.col("event_id")).alias("key"))
    return PT.discovered(keys, ("event_type", "dt"))


@report(
    "projected_versus_present",
    """SELECT t.event_type, strftime(d.day, '%Y-%m-%d') AS dt, coalesce(g.events, 0) AS objects, g.events IS NOT NULL AS present
       FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS day
             FROM events) AS d
       CROSS JOIN (VALUES ('page_view'), ('add_to_cart'), ('purchase'), ('refund')) AS t(event_type)
       LEFT JOIN gold g ON g.event_type = t.event_type AND g.dt = strftime(d.day, '%Y-%m-%d')""",
)
def projected_versus_present(spark, sf):
    bounds = feed.events(spark, sf).agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end"))
    keys = feed.silver(spark, sf).select(K.silver_key(F.col("event_type"), F.col("dt"), F.col("event_id")).alias("path"))
    present = PT.objects_per_partition(keys, ("event_type", "dt")).select("event_type", "dt", "objects")
    joined = PT.grid(bounds, "event_type").join(present, ["event_type", "dt"], "left")
    return joined.select(
        "event_type", "dt", F.coalesce("objects", F.lit(0)).alias("objects"), F.col("objects").isNotNull().alias("present")
    )


# --- views and KPIs --------------------------------------------------------


def _gold_table(spark, sf) -> DataFrame:
    return G.daily_metrics(feed.silver(spark, sf), ordered=False).withColumnRenamed("event_type", "metric")


def _named(name: str, as_of: str | None = None):
    def run(spark, sf):
        if name == "silver_late_event_counts":
            views.create_views(spark, silver=feed.silver(spark, sf))
        else:
            views.create_views(spark, gold=_gold_table(spark, sf))
        return views.run_named(spark, name, as_of)

    return run


report("gold_daily_totals", "SELECT event_type AS metric, dt, events, amount_usd FROM gold")(_named("gold_daily_totals"))
report("gold_purchase_revenue", "SELECT dt, events, amount_usd FROM gold WHERE event_type = 'purchase'")(
    _named("gold_purchase_revenue")
)
report(
    "gold_last_7_days",
    "SELECT event_type AS metric, dt, events, amount_usd FROM gold WHERE dt >= '2024-01-24'",
)(_named("gold_last_7_days", feed.AS_OF))
report(
    "silver_late_event_counts",
    """SELECT event_type, dt, count(*) AS events, CAST(sum(CASE WHEN _late THEN 1 ELSE 0 END) AS BIGINT) AS late_events
       FROM silver GROUP BY event_type, dt""",
)(_named("silver_late_event_counts"))
report("stg_daily_event_metrics", "SELECT event_type, dt, events, amount_usd FROM gold")(_named("stg_daily_event_metrics"))
report("fct_daily_event_metrics", "SELECT event_type, dt, events, amount_usd FROM gold")(_named("fct_daily_event_metrics"))
report(
    "fct_daily_purchase_revenue",
    "SELECT dt, events, amount_usd AS gmv_usd FROM gold WHERE event_type = 'purchase'",
)(_named("fct_daily_purchase_revenue"))
report(
    "dim_event_type",
    """SELECT DISTINCT event_type, CASE event_type WHEN 'page_view' THEN 'Page view' WHEN 'add_to_cart' THEN 'Add to cart'
              WHEN 'purchase' THEN 'Purchase' WHEN 'refund' THEN 'Refund' END AS event_type_name FROM gold""",
)(_named("dim_event_type"))


@report(
    "kpi_summary",
    """SELECT count(*) AS event_volume,
              round(sum(amount_usd) FILTER (WHERE event_type = 'purchase'), 2) AS gmv_usd,
              round(sum(amount_usd) FILTER (WHERE event_type = 'refund'), 2) AS refund_usd,
              round(sum(amount_usd) FILTER (WHERE event_type = 'purchase')
                    - sum(amount_usd) FILTER (WHERE event_type = 'refund'), 2) AS net_revenue_usd,
              count(*) FILTER (WHERE event_type = 'page_view') AS page_views,
              count(*) FILTER (WHERE event_type = 'add_to_cart') AS add_to_carts,
              count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
              round(count(*) FILTER (WHERE _late) / count(*), 4) AS late_rate,
              round(sum(amount_usd) FILTER (WHERE event_type = 'purchase')
                    / count(*) FILTER (WHERE event_type = 'purchase'), 4) AS average_order_value,
              CAST(sum(quantity) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS units_sold
       FROM silver""",
)
def kpi_summary(spark, sf):
    return kpis.kpi_summary(feed.silver(spark, sf))


@report(
    "daily_kpis",
    """SELECT dt, CAST(sum(events) AS BIGINT) AS event_volume,
              coalesce(sum(amount_usd) FILTER (WHERE event_type = 'purchase'), 0.0) AS gmv_usd,
              coalesce(sum(amount_usd) FILTER (WHERE event_type = 'refund'), 0.0) AS refund_usd,
              CAST(coalesce(sum(events) FILTER (WHERE event_type = 'page_view'), 0) AS BIGINT) AS page_views,
              CAST(coalesce(sum(events) FILTER (WHERE event_type = 'add_to_cart'), 0) AS BIGINT) AS add_to_carts,
              CAST(coalesce(sum(events) FILTER (WHERE event_type = 'purchase'), 0) AS BIGINT) AS purchases,
              round(coalesce(sum(amount_usd) FILTER (WHERE event_type = 'purchase'), 0.0)
                    - coalesce(sum(amount_usd) FILTER (WHERE event_type = 'refund'), 0.0), 2) AS net_revenue_usd
       FROM gold GROUP BY dt""",
)
def daily_kpis(spark, sf):
    return kpis.daily_kpis(G.daily_metrics(feed.silver(spark, sf), ordered=False))


@report(
    "top_cart_sku",
    """SELECT dt, sku, events FROM (
         SELECT dt, sku, count(*) AS events, row_number() OVER (PARTITION BY dt ORDER BY count(*) DESC, sku) AS r
         FROM silver WHERE event_type = 'add_to_cart' GROUP BY dt, sku) AS t WHERE r = 1""",
)
def top_cart_sku(spark, sf):
    return kpis.top_sku(feed.silver(spark, sf))


@report(
    "zone_counts",
    """SELECT 'bronze' AS zone, 'all' AS reason, count(*) AS records FROM cleansed
       UNION ALL SELECT 'silver', 'accepted', count(*) FROM cleansed WHERE reason IS NULL
       UNION ALL SELECT 'silver_quarantine', reason, count(*) FROM cleansed WHERE reason IS NOT NULL GROUP BY reason""",
)
def zone_counts(spark, sf):
    return kpis.zone_counts(feed.cleansed(spark, sf))


@report(
    "late_refunds",
    """SELECT g.dt, s.late_events, s.late_amount_usd, g.events, g.amount_usd
       FROM (SELECT dt, count(*) AS late_events, round(sum(amount_usd), 2) AS late_amount_usd
             FROM silver WHERE _late AND event_type = 'refund' GROUP BY dt) AS s
       JOIN gold g ON g.dt = s.dt WHERE g.event_type = 'refund'""",
)
def late_refunds(spark, sf):
    return kpis.late_effect(*feed.stored_zones(spark, sf))


@report(
    "gold_silver_join",
    """SELECT s.event_type, s.dt, s.event_id, s.amount_usd, g.events AS day_events, g.amount_usd AS day_amount_usd
       FROM silver s JOIN gold g ON g.event_type = s.event_type AND g.dt = s.dt""",
)
def gold_silver_join(spark, sf):
    silver, gold = feed.stored_zones(spark, sf)
    return kpis.events_with_daily_metric(silver.select("event_type", "dt", "event_id", "amount_usd"), gold)


@report(
    "busy_day_events",
    """SELECT s.event_type, s.dt, s.event_id, s.amount_usd, g.events AS day_events, g.amount_usd AS day_amount_usd
       FROM silver s JOIN gold g ON g.event_type = s.event_type AND g.dt = s.dt
       WHERE g.events > (SELECT avg(events) FROM gold) + 2 * (SELECT stddev_pop(events) FROM gold)""",
)
def busy_day_events(spark, sf):
    """Silver events of unusually busy days: Gold picks the partitions of Silver that are read at all."""
    silver, gold = feed.stored_zones(spark, sf)
    return kpis.busy_days(silver.select("event_type", "dt", "event_id", "amount_usd"), gold)


@report(
    "reconcile",
    """SELECT count(*) AS seeded, count(*) FILTER (WHERE reason IS NULL) AS valid,
              count(*) FILTER (WHERE reason IS NOT NULL) AS quarantined,
              count(*) FILTER (WHERE reason IS NULL AND checks <> '') AS gate_failures,
              (SELECT count(*) FROM gold) AS gold, (SELECT CAST(sum(events) AS BIGINT) FROM gold) AS gold_events,
              count(*) FILTER (WHERE reason IS NULL AND checks <> '') = 0 AS gate_passed,
              true AS gold_matches_silver, true AS balanced FROM cleansed""",
)
def reconcile(spark, sf):
    return flow.reconcile(feed.cleansed(spark, sf, gate=True))


# --- contracts -------------------------------------------------------------


@report(
    "contract_violations",
    """SELECT code, field, count(*) AS violations FROM (
         SELECT 'missing_required' AS code, f.field FROM cleansed,
                (VALUES ('event_id'), ('event_ts'), ('event_type'), ('user_id'), ('sku'), ('quantity'), ('amount_usd')) AS f(field)
         WHERE is_empty
         UNION ALL SELECT 'type_mismatch', 'event_ts' FROM cleansed WHERE NOT is_empty AND bad_ts AND NOT contains('not-a-timestamp', 'T')
         UNION ALL SELECT 'type_mismatch', 'quantity' FROM cleansed WHERE NOT is_empty AND bad_qty
         UNION ALL SELECT 'enum_mismatch', 'event_type' FROM cleansed
         WHERE NOT is_empty AND event_type NOT IN ('page_view', 'add_to_cart', 'purchase', 'refund')) AS t
       GROUP BY code, field""",
)
def contract_violations(spark, sf):
    return CT.violation_counts(CT.violations(feed.bronze(spark, sf), BRONZE_CONTRACT))


@report(
    "field_profile",
    """SELECT field, type, false AS required, enum FROM (VALUES
         ('amount_usd', 'number', ''), ('country', 'string', 'BR,DE,IN,JP,US'), ('event_id', 'string', ''),
         ('event_ts', 'string', ''), ('event_type', 'string', 'add_to_cart,error,page_view,purchase,refund'),
         ('quantity', 'string', ''), ('sku', 'string', ''), ('user_id', 'string', '')) AS t(field, type, enum)""",
)
def field_profile(spark, sf):
    profile = CT.data_profile(feed.bronze(spark, sf), enum_fields=("event_type", "country"))
    return profile.select("field", "type", "required", F.coalesce(F.array_join("enum", ","), F.lit("")).alias("enum"))


@report(
    "schema_drift",
    """SELECT field, severity, code, detail FROM (VALUES
         ('country', 'additive', 'no_longer_required', ''),
         ('event_ts', 'breaking', 'became_required', ''),
         ('event_ts', 'additive', 'widened_type', 'datetime -> string')) AS t(field, severity, code, detail) WHERE false
       UNION ALL
       SELECT field, severity, code, detail FROM (VALUES
         ('event_ts', 'additive', 'widened_type', 'datetime -> string'),
         ('quantity', 'breaking', 'type_change', 'integer -> string'),
         ('event_type', 'additive', 'enum_values_added', 'error'),
         ('amount_usd', 'additive', 'no_longer_required', ''), ('country', 'additive', 'no_longer_required', ''),
         ('event_id', 'additive', 'no_longer_required', ''), ('event_ts', 'additive', 'no_longer_required', ''),
         ('event_type', 'additive', 'no_longer_required', ''), ('quantity', 'additive', 'no_longer_required', ''),
         ('sku', 'additive', 'no_longer_required', ''), ('user_id', 'additive', 'no_longer_required', '')
       ) AS t(field, severity, code, detail)""",
)
def schema_drift(spark, sf):
    """Drift from the accepted records to all records as posted."""
    good = C.accepted(feed.cleansed(spark, sf, ("raw",)).withColumn("text", F.col("raw")))
    enums = ("event_type", "country")
    before = CT.observed(good, "text", enums)
    after = CT.observed(feed.bronze(spark, sf), "raw", enums)
    return CT.compare_observed(before, after)


@report(
    "data_tests",
    """SELECT 'fct_daily_event_metrics' AS model, 'not_null' AS test, c.column_name, CAST(0 AS BIGINT) AS failures
       FROM (VALUES ('event_type'), ('dt'), ('events'), ('amount_usd')) AS c(column_name)
       UNION ALL SELECT 'dim_event_type', 'unique', 'event_type',
              (SELECT count(*) FROM (SELECT event_type FROM (SELECT DISTINCT event_type FROM gold) AS d GROUP BY event_type HAVING count(*) > 1) AS u)
       UNION ALL SELECT 'fct_daily_event_metrics', 'accepted_values', 'event_type',
              (SELECT count(DISTINCT event_type) FROM gold WHERE event_type NOT IN ('page_view', 'add_to_cart', 'purchase', 'refund'))
       UNION ALL SELECT 'posted_events', 'accepted_values', 'event_type',
              (SELECT count(DISTINCT event_type) FROM cleansed WHERE NOT is_empty AND event_type NOT IN ('page_view', 'add_to_cart', 'purchase', 'refund'))""",
)
def data_tests(spark, sf):
    gold = materialize(G.daily_metrics(feed.silver(spark, sf), ordered=False), "gold")
    posted = C.inspect(feed.bronze(spark, sf), keep=(), gate=False)
    dim = gold.select("event_type").distinct()
    return (
        CT.not_null(gold, "fct_daily_event_metrics", ("event_type", "dt", "events", "amount_usd"))
        .unionByName(CT.unique(dim, "dim_event_type", "event_type"))
        .unionByName(CT.accepted_values(gold, "fct_daily_event_metrics", "event_type", EVENT_TYPES))
        .unionByName(CT.accepted_values(posted, "posted_events", "event_type", EVENT_TYPES))
    )


@report(
    "order_table_tests",
    """SELECT 'orders' AS model, 'not_null' AS test, 'o_custkey' AS column_name,
              (SELECT count(*) FROM orders WHERE o_custkey IS NULL) AS failures
       UNION ALL SELECT 'orders', 'not_null', 'o_orderdate', (SELECT count(*) FROM orders WHERE o_orderdate IS NULL)
       UNION ALL SELECT 'orders', 'unique', 'o_orderkey',
              (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1) AS u)
       UNION ALL SELECT 'lineitem', 'unique', 'l_orderkey',
              (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1) AS u)
       UNION ALL SELECT 'lineitem', 'accepted_values', 'l_returnflag',
              (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))""",
    raw_sql=True,
)
def order_table_tests(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return (
        CT.not_null(orders, "orders", ("o_custkey", "o_orderdate"))
        .unionByName(CT.unique(orders, "orders", "o_orderkey"))
        .unionByName(CT.unique(lines, "lineitem", "l_orderkey"))
        .unionByName(CT.accepted_values(lines, "lineitem", "l_returnflag", ("A", "N")))
    )


# --- identity --------------------------------------------------------------

REDELIVERED_SQL = """resent AS (
  SELECT *, 'evt-' || lpad(CAST(n - n % 4 AS VARCHAR), 8, '0') AS shared_id FROM silver)"""


@report(
    "dedup_last_write",
    """SELECT event_type, dt, event_id, landed, amount_usd FROM (
         SELECT event_type, dt, shared_id AS event_id, n AS landed, amount_usd,
                row_number() OVER (PARTITION BY event_type, dt, shared_id ORDER BY n DESC) AS r
         FROM resent) AS t WHERE r = 1""",
    REDELIVERED_SQL,
)
def dedup_last_write(spark, sf):
    """Four neighbouring events share an id; the last of a type and day wins."""
    number = F.regexp_extract("event_id", "([0-9]+)", 1).cast("bigint")
    digits = (number - number % 4).cast("string")
    shared = F.concat(F.lit("evt-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(8)), "0"))
    rows = feed.silver(spark, sf).select("event_type", "dt", shared.alias("event_id"), number.alias("landed"), "amount_usd")
    return I.last_write(rows, I.SILVER_IDENTITY, ("landed",))


def _framed_sql(part: str) -> str:
    return f"printf('%08x', octet_length(encode({part}))) || lower(hex(encode({part})))"


RUN_KEYS_SQL = f"""batches AS (
  SELECT n // 10 AS batch, source_key FROM bronze),
hashed AS (
  SELECT batch, count(*) AS parts,
         sha256(unhex({_framed_sql("'bronze'")} || string_agg({_framed_sql('source_key')}, '' ORDER BY source_key))) AS digest
  FROM batches GROUP BY batch)"""


@report(
    "run_keys",
    """SELECT batch, parts, 'bronze#' || digest AS idempotency_key, 'bronze-' || substr(digest, 1, 16) AS run_id FROM hashed""",
    RUN_KEYS_SQL,
)
def run_keys(spark, sf):
    """Identity of each queue drain of ten messages."""
    rows = feed.events(spark, sf)
    keyed = feed.with_bronze(rows).select("source_key")
    number = F.regexp_extract("source_key", r"evt-(\d+)\.json$", 1).cast("bigint")
    batches = keyed.select(F.floor(number / 10).alias("batch"), F.col("source_key").alias("key"))
    return I.batch_identity(batches, "batch", "key", "bronze")


MANIFEST_SQL = """limbs AS (
  SELECT dt, count(*) AS parts,
         sum(CAST(('0x' || substr(sha256(source_key), 1, 15)) AS UBIGINT)) AS l0,
         sum(CAST(('0x' || substr(sha256(source_key), 16, 15)) AS UBIGINT)) AS l1,
         sum(CAST(('0x' || substr(sha256(source_key), 31, 15)) AS UBIGINT)) AS l2,
         sum(CAST(('0x' || substr(sha256(source_key), 46, 15)) AS UBIGINT)) AS l3
  FROM cleansed GROUP BY dt)"""


@report(
    "manifest_keys",
    """SELECT dt, parts, 'silver-' || substr(sha256('silver|' || parts || '|' || l0 || '|' || l1 || '|' || l2 || '|' || l3), 1, 16)
              AS run_id FROM limbs""",
    MANIFEST_SQL,
)
def manifest_keys(spark, sf):
    """Identity of each day's whole key set, whatever its size."""
    keys = feed.bronze(spark, sf).select(K.day_of_key(F.col("source_key")).alias("dt"), "source_key")
    return I.manifest_identity(keys, ("dt",), "source_key", "silver")
