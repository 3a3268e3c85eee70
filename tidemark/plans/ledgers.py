"""The registered queries over run records, settings and sinks that are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import days as D
from tidemark.functions import keys as K
from tidemark.operators import cleanse as C
from tidemark.operators import contracts as CT
from tidemark.operators import gold as G
from tidemark.operators import merge as MG
from tidemark.operators import partitions as PT
from tidemark.operators import runs as R
from tidemark.plans import feed, flow
from tidemark.plans.operations import RUN_LOG_SQL, _run_log, _stored_gold, _stored_silver
from tidemark.plans.reports import report
from tidemark.session import materialize, scratch_path
from tidemark.sources import generator, objects, sinks

# --- runs ------------------------------------------------------------------


@report(
    "run_completion",
    """SELECT run_id, CASE WHEN version % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS status,
              strftime(started_at + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS finished_at,
              CASE WHEN version % 2 <> 0 THEN 'version ' || version END AS error,
              '{"seen":"1","done":"' || version || '"}' AS metrics
       FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, version DESC) AS r FROM run_log) AS t
       WHERE r = 1 AND status = 'running'""",
    RUN_LOG_SQL,
)
def run_completion(spark, sf):
    """Open runs completed: status, finish time, error, and counters merged with the ones they had."""
    log = _run_log(spark, sf).withColumn("metrics", F.lit('{"seen":"1","done":"0"}'))
    open_runs = R.latest_versions(log, ("started_at", "version")).filter("status = 'running'")
    even = F.col("version") % 2 == 0
    done = R.complete(
        open_runs,
        F.when(even, "succeeded").otherwise("failed"),
        F.col("started_at") + F.expr("INTERVAL 1 HOUR"),
        F.when(~even, F.concat(F.lit("version "), "version")),
        F.create_map(F.lit("done"), F.col("version").cast("string")),
    )
    finished = F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("finished_at")
    return done.select("run_id", "status", finished, "error", "metrics")


@report("run_lookup", "SELECT run_id, status FROM latest WHERE run_id = 'run-7'", RUN_LOG_SQL)
def run_lookup(spark, sf):
    latest = R.latest_versions(_run_log(spark, sf), ("started_at", "version"))
    return R.find_run(latest, "run-7").select("run_id", "status")


# --- settings and keys -----------------------------------------------------


@report(
    "trigger_settings",
    """SELECT n, CAST(CASE n % 4 WHEN 0 THEN n % 5 ELSE 2 END AS BIGINT) AS lookback_days,
              CASE n % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN '2024-01-05 00:00:00' END AS watermark FROM bronze""",
)
def trigger_settings(spark, sf):
    """Lookback days and watermark of triggers, from texts that may be blank, negative or junk."""
    n = F.col("event_id")
    lookback = F.when(n % 4 == 0, (n % 5).cast("string")).when(n % 4 == 1, "-3").when(n % 4 == 2, "junk")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    override = F.when(n % 3 == 0, "").when(n % 3 == 1, "2024-01-05T00:00:00Z")
    as_of = F.when(n % 3 == 2, "").otherwise(stamp)
    rows = feed.events(spark, sf).select(n.alias("n"), lookback.alias("lookback"), override.alias("override"), as_of.alias("as_of"))
    return rows.select(
        "n",
        D.lookback_setting(F.col("lookback")).alias("lookback_days"),
        F.date_format(D.watermark_setting(F.col("override"), F.col("as_of")), "yyyy-MM-dd HH:mm:ss").alias("watermark"),
    )


@report("key_parts", "SELECT event_id, event_type, dt, 2 AS parts FROM silver")
def key_parts(spark, sf):
    """Name=value segments of keys with a blank and a repeated one; the last of a name counts."""
    rows = feed.silver(spark, sf).select("event_id", K.silver_key(F.col("event_type"), F.col("dt"), F.col("event_id")).alias("key"))
    parts = K.hive_parts(F.concat(F.lit("zone/none=/dt=1999-01-01/"), "key"))
    return rows.withColumn("parts", parts).select(
        "event_id", F.col("parts")["event_type"].alias("event_type"), F.col("parts")["dt"].alias("dt"), F.size("parts").alias("parts")
    )


@report(
    "names_drift",
    """SELECT dt AS field, 'breaking' AS severity, 'removed_day' AS code FROM (SELECT DISTINCT dt FROM silver WHERE dt <= '2024-01-10')
       UNION ALL SELECT dt, 'additive', 'added_day' FROM (SELECT DISTINCT dt FROM silver WHERE dt > '2024-01-20')""",
)
def names_drift(spark, sf):
    """Days that an earlier and a later list of partitions do not share."""
    days = materialize(feed.silver(spark, sf).select("dt").distinct(), "days")
    return CT.compare_names(days.filter("dt <= '2024-01-20'"), days.filter("dt > '2024-01-10'"), "removed_day", "added_day")


# --- sinks read back -------------------------------------------------------


@report(
    "quarantine_sink",
    """SELECT reason, count(*) AS records, count(*) FILTER (WHERE event_id <> '') AS named FROM cleansed
       WHERE reason IS NOT NULL AND reason <> 'unknown_event_type' GROUP BY reason""",
)
def quarantine_sink(spark, sf):
    """Silver quarantine of a run that is repeated without one of its reasons: nothing of the first attempt is left."""
    path = scratch_path(spark, "quarantine")
    bad = materialize(C.quarantined(feed.cleansed(spark, sf, ("source_key", "landed_at", "raw"), gate=True)), "refused")
    sinks.write_silver_quarantine(bad, path, "run-1")
    sinks.write_silver_quarantine(bad.filter("reason <> 'unknown_event_type'"), path, "run-1")
    stored = spark.read.parquet(path).filter("run_id = 'run-1' AND payload IS NOT NULL")
    return stored.groupBy("reason").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~F.col("event_id").isin("unknown", "")).alias("named")
    )


@report(
    "gold_rejects_merged",
    """SELECT 'unknown_event_type' AS reason, 'error' AS metric, dt,
              CASE WHEN dt > '2024-01-15' THEN 2 ELSE 1 END AS record_count, CASE WHEN dt > '2024-01-15' THEN 2 ELSE 1 END AS compacted_from
       FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS dt FROM bronze WHERE event_type = 'error')""",
)
def gold_rejects_merged(spark, sf):
    """Rejected metrics of two runs, the first repeated, read back and merged by reason, metric and day."""
    root = scratch_path(spark, "rejects")
    typed = feed.events(spark, sf).select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("dt"), F.abs("value").alias("amount_usd"))
    known = F.when(F.col("event_type") == "error", "error").otherwise("purchase")
    metrics = materialize(G.daily_metrics(typed.withColumn("event_type", known), ordered=False), "metrics")
    for run_id, rows in (("run-1", metrics), ("run-2", metrics.filter("dt > '2024-01-15'")), ("run-1", metrics)):
        sinks.publish_metrics(rows, root, run_id)
    return MG.merge_gold_rejects(sinks.read_gold_quarantine(spark, f"{root}/gold/quarantine"))


@report(
    "zone_partitions",
    """SELECT zone, coalesce(e.name, p.name) AS name, coalesce(e.dt, p.dt) AS dt, e.name IS NOT NULL AS expected, p.name IS NOT NULL AS present
       FROM (VALUES ('silver'), ('gold')) AS z(zone),
            (SELECT t.name, strftime(d.day, '%Y-%m-%d') AS dt
             FROM (VALUES ('page_view'), ('add_to_cart'), ('purchase'), ('refund')) AS t(name),
                  generate_series(DATE '2024-01-25', DATE '2024-02-03', INTERVAL 1 DAY) AS d(day)) AS e
            FULL OUTER JOIN (SELECT event_type AS name, dt FROM gold) AS p ON p.name = e.name AND p.dt = e.dt""",
)
def zone_partitions(spark, sf):
    """The window's partitions beside those stored, Silver and Gold."""
    start, end = D.window_bounds("2024-02-03", 9)
    silver = objects.inventory(spark, _stored_silver(spark, sf), "*.parquet")
    gold = objects.inventory(spark, _stored_gold(spark, sf), "*.parquet")
    described = PT.describe_zone(silver, "silver", "event_type", start, end)
    return described.unionByName(PT.describe_zone(gold, "gold", "metric", start, end))


@report(
    "seeded_zone",
    """SELECT strftime(TIMESTAMP '2026-01-01 00:00:00' + to_minutes(event_id), '%Y-%m-%d') AS dt, count(*) AS records,
              min(event_id) AS first_minute FROM (SELECT row_number() OVER () - 1 AS event_id FROM events) GROUP BY 1""",
    raw_sql=True,
)
def seeded_zone(spark, sf):
    """A generated Bronze zone, as many events as the table has, read back by its day folders."""
    path = scratch_path(spark, "seed")
    generator.seed_bronze(spark, feed.events(spark, sf).count(), path)
    landed = spark.read.parquet(path)
    minute = F.regexp_extract("source_key", r"evt-0042-(\d+)\.json$", 1).cast("bigint")
    return landed.groupBy("dt").agg(F.count(F.lit(1)).alias("records"), F.min(minute).alias("first_minute"))


@report(
    "closed_batch",
    """SELECT count(*) AS seeded, count(*) FILTER (WHERE reason IS NULL) AS valid, count(*) FILTER (WHERE reason IS NOT NULL) AS quarantined,
              count(*) FILTER (WHERE reason IS NULL AND checks <> '') AS gate_failures, (SELECT count(*) FROM gold) AS gold,
              CAST((SELECT sum(events) FROM gold) AS BIGINT) AS gold_events,
              count(*) FILTER (WHERE reason IS NULL AND checks <> '') = 0 AS gate_passed,
              (SELECT sum(events) FROM gold) = count(*) FILTER (WHERE reason IS NULL) AS gold_matches_silver,
              count(*) = count(*) FILTER (WHERE reason IS NULL) + count(*) FILTER (WHERE reason IS NOT NULL) AS balanced,
              count(*) FILTER (WHERE reason IS NULL AND event_ts < TIMESTAMP '2010-01-01') AS late,
              strftime(max(event_ts) FILTER (WHERE reason IS NULL) + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS watermark FROM cleansed""",
)
def closed_batch(spark, sf):
    row = flow.closed_batch(feed.bronze(spark, sf))
    return row.withColumn("watermark", F.date_format("watermark", "yyyy-MM-dd HH:mm:ss"))
