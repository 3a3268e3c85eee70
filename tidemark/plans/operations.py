"""The registered queries over runs, lineage, maintenance, sources and streams."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import digest
from tidemark.functions import keys as K
from tidemark.operators import cleanse as C
from tidemark.operators import gold as G
from tidemark.operators import identity as I
from tidemark.operators import maintenance as M
from tidemark.operators import merge as MG
from tidemark.operators import observe as O
from tidemark.operators import partitions as PT
from tidemark.operators import quality as Q
from tidemark.operators import runs as R
from tidemark.plans import feed, flow, upkeep
from tidemark.plans.oracle import whole_numbers, with_ctes
from tidemark.plans.reports import QUALITY_TALLY_SQL, _framed_sql, report
from tidemark.schemas import BRONZE_SCHEMA, GOLD_CONTRACT, SILVER_SCHEMA
from tidemark.session import materialize, scratch_path
from tidemark.sources import catalog, deadletter, generator, objects, sinks
from tidemark.sources.notifications import extract_refs
from tidemark.streaming import jobs, producer, records


def _landing_day():
    return K.day_of_key(F.col("source_key"))


# --- runs ------------------------------------------------------------------

RUN_LOG_SQL = """run_log AS (
  SELECT 'run-' || (event_id // 10) AS run_id, event_id AS version, ts AS started_at,
         CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status
  FROM events),
latest AS (
  SELECT run_id, status, started_at FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, version DESC) AS r FROM run_log) AS t
  WHERE r = 1)"""


def _run_log(spark, sf) -> DataFrame:
    return feed.events(spark, sf).selectExpr(
        "concat('run-', event_id DIV 10) AS run_id",
        "event_id AS version",
        "CAST(ts AS TIMESTAMP) AS started_at",
        "CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status",
    )


def _micro(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


@report(
    "run_versions",
    "SELECT run_id, status, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at FROM latest",
    RUN_LOG_SQL,
)
def run_versions(spark, sf):
    latest = R.latest_versions(_run_log(spark, sf), ("started_at", "version"))
    return latest.select("run_id", "status", _micro("started_at"))


@report(
    "latest_runs",
    """SELECT run_id, status, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at FROM latest
       ORDER BY latest.started_at DESC, run_id LIMIT 50""",
    RUN_LOG_SQL,
)
def latest_runs(spark, sf):
    latest = R.latest_versions(_run_log(spark, sf), ("started_at", "version"))
    return R.latest_runs(latest, 50).select("run_id", "status", _micro("started_at"))


CANDIDATES_SQL = f"""candidates AS (
  SELECT event_type, dt,
         'silver-' || substr(sha256(unhex({_framed_sql("'silver'")} || {_framed_sql('dt')} || {_framed_sql('event_type')})), 1, 16)
           AS run_id
  FROM gold)"""


def _candidates(spark, sf) -> DataFrame:
    touched = feed.silver(spark, sf).select("event_type", "dt").distinct()
    return touched.withColumn("run_id", digest.run_id("silver", F.array("event_type", "dt")))


def _history(candidates: DataFrame) -> DataFrame:
    """Runs of the first half of the month; refund runs failed."""
    status = F.when(F.col("event_type") == "refund", "failed").otherwise("succeeded")
    return candidates.filter(F.col("dt") < "2024-01-16").select("run_id", status.alias("status"))


@report(
    "replay_skip",
    "SELECT event_type, dt, run_id FROM candidates WHERE dt >= '2024-01-16' OR event_type = 'refund'",
    CANDIDATES_SQL,
)
def replay_skip(spark, sf):
    candidates = _candidates(spark, sf)
    return I.pending_work(candidates, _history(candidates)).select("event_type", "dt", "run_id")


@report(
    "replayed_runs",
    "SELECT event_type, dt, run_id FROM candidates WHERE dt < '2024-01-16' AND event_type <> 'refund'",
    CANDIDATES_SQL,
)
def replayed_runs(spark, sf):
    candidates = _candidates(spark, sf)
    return I.replays(candidates, _history(candidates)).select("event_type", "dt", "run_id")


STEPS_SQL = """steps AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN is_empty THEN 'none' ELSE event_type END AS posted,
         count(*) FILTER (WHERE reason IS NULL) AS found, count(*) FILTER (WHERE reason IS NOT NULL) AS missing,
         count(*) FILTER (WHERE reason IS NULL AND checks <> '') AS failing
  FROM cleansed GROUP BY 1, 2)"""


@report(
    "run_outcomes",
    """SELECT day, posted, found, missing,
              CASE WHEN missing > 0 AND found = 0 THEN 'failed' WHEN failing > 0 THEN 'quality_failed' ELSE 'succeeded' END
                AS status FROM steps""",
    STEPS_SQL,
)
def run_outcomes(spark, sf):
    rows = feed.cleansed(spark, sf, ("source_key",), gate=True)
    ok = F.col("reason").isNull()
    steps = rows.groupBy(_landing_day().alias("day"), F.coalesce("event_type", F.lit("none")).alias("posted")).agg(
        F.count_if(ok).alias("found"),
        F.count_if(~ok).alias("missing"),
        F.count_if(ok & (F.size("checks") > 0)).alias("failing"),
    )
    status = R.step_outcome(F.col("found"), F.col("missing"), F.col("failing") == 0, F.lit("fail"))
    return steps.select("day", "posted", "found", "missing", status.alias("status"))


def _zone_runs(spark, sf) -> DataFrame:
    """One run per landing day and zone, with its counters as JSON."""
    rows = feed.cleansed(spark, sf, ("source_key", "landed_at"), gate=True)
    ok = F.col("reason").isNull()
    by_group = rows.groupBy(_landing_day().alias("day"), "event_type").agg(
        F.count_if(ok).alias("valid"),
        F.count_if(~ok).alias("quarantined"),
        F.count_if("_late").alias("late"),
        F.count_if(ok & (F.size("checks") > 0)).alias("failing"),
        F.max("landed_at").alias("landed_at"),
        F.max(F.when(ok, F.col("event_ts"))).alias("latest_event_ts"),
    )
    days = by_group.groupBy("day").agg(
        *[F.sum(c).alias(c) for c in ("valid", "quarantined", "late", "failing")],
        F.count_if(F.col("valid") > 0).alias("metrics"),
        F.max("landed_at").alias("landed_at"),
        F.max("latest_event_ts").alias("latest_event_ts"),
    )
    return days.selectExpr(
        "day",
        "to_timestamp(day) AS started_at",
        "date_trunc('second', landed_at) + INTERVAL 1 HOUR AS finished_at",
        "latest_event_ts",
        """inline(array(
             struct('silver' AS zone, to_json(struct(valid, quarantined, late, valid AS silver_written)) AS metrics),
             struct('quality' AS zone, to_json(struct(valid AS rows_scanned, failing AS rows_failed)) AS metrics),
             struct('gold' AS zone, to_json(struct(valid AS silver_read, metrics AS gold_written)) AS metrics)))""",
    ).selectExpr("concat(zone, '-', day) AS run_id", "'succeeded' AS status", "*")


DAY_RUNS_SQL = """days AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE reason IS NULL) AS valid,
         count(*) FILTER (WHERE reason IS NOT NULL) AS quarantined,
         count(*) FILTER (WHERE reason IS NULL AND _late) AS late,
         count(*) FILTER (WHERE reason IS NULL AND checks <> '') AS failing,
         count(DISTINCT event_type) FILTER (WHERE reason IS NULL) AS metrics,
         date_trunc('second', max(ts)) + INTERVAL 1 HOUR AS finished_at,
         max(event_ts) FILTER (WHERE reason IS NULL) AS latest_event_ts
  FROM cleansed GROUP BY 1)"""

_ZONE_VALUES = {
    "silver": {
        "RecordsProcessed": ("valid", "Count"),
        "QualityFailures": ("quarantined", "Count"),
        "LateEvents": ("late", "Count"),
        "ObjectsWritten": ("valid", "Count"),
        "EstimatedBytes": ("valid * 2048", "Bytes"),
    },
    "quality": {
        "RecordsProcessed": ("valid", "Count"),
        "QualityFailures": ("failing", "Count"),
        "QualityFailRatio": ("CASE WHEN valid = 0 THEN 0.0 ELSE failing / valid END", "None"),
        "ObjectsWritten": ("0", "Count"),
        "EstimatedBytes": ("valid * 2048", "Bytes"),
    },
    "gold": {
        "RecordsProcessed": ("valid", "Count"),
        "ObjectsWritten": ("metrics", "Count"),
        "EstimatedBytes": ("valid * 2048 + metrics * 8192", "Bytes"),
    },
}
_COMMON_VALUES = {
    "RunDurationMilliseconds": ("(epoch_us(finished_at) - epoch_us(CAST(day AS TIMESTAMP))) / 1000.0", "Milliseconds"),
    "PipelineLagSeconds": ("(epoch_us(finished_at) - epoch_us(latest_event_ts)) / 1000000.0", "Seconds"),
}


def _points_sql() -> str:
    selects = [
        f"SELECT '{zone}-' || day AS run_id, '{zone}' AS zone, 'succeeded' AS status, '{name}' AS name, "
        f"CAST({value} AS DOUBLE) AS value, '{unit}' AS unit FROM days"
        for zone, values in _ZONE_VALUES.items()
        for name, (value, unit) in {**values, **_COMMON_VALUES}.items()
    ]
    return "\nUNION ALL ".join(selects)


@report("metric_points", _points_sql(), DAY_RUNS_SQL)
def metric_points(spark, sf):
    return R.metric_points(_zone_runs(spark, sf)).drop("timestamp")


@report(
    "run_counters",
    """SELECT 'silver-' || day AS run_id, c.name, CASE c.name WHEN 'valid' THEN valid WHEN 'quarantined' THEN quarantined
              WHEN 'late' THEN late ELSE valid END::VARCHAR AS value
       FROM days, (VALUES ('valid'), ('quarantined'), ('late'), ('silver_written')) AS c(name)""",
    DAY_RUNS_SQL,
)
def run_counters(spark, sf):
    return R.counters(_zone_runs(spark, sf).filter(F.col("zone") == "silver"))


@report(
    "freshness",
    """SELECT event_type, strftime(max(event_ts), '%Y-%m-%d %H:%M:%S') AS last_written,
              round((epoch_us(TIMESTAMP '2024-01-31 23:30:00') - epoch_us(max(event_ts))) / 3600000000.0, 3) AS age_hours,
              CASE WHEN round((epoch_us(TIMESTAMP '2024-01-31 23:30:00') - epoch_us(max(event_ts))) / 3600000000.0, 3) <= 24
                   THEN 'ok' ELSE 'breached' END AS status
       FROM silver GROUP BY event_type""",
)
def freshness(spark, sf):
    written = feed.silver(spark, sf).groupBy("event_type").agg(F.max("event_ts").alias("last_written"))
    checked = O.freshness(written, "2024-01-31T23:30:00Z")
    shown = F.date_format("last_written", "yyyy-MM-dd HH:mm:ss").alias("last_written")
    return checked.select("event_type", shown, "age_hours", "status")


# --- lineage ---------------------------------------------------------------


def _zone_sizes(spark, sf) -> DataFrame:
    """One row of object counts per lineage node, from a small grouping."""
    rows = feed.cleansed(spark, sf, ("source_key",), gate=True)
    ok = F.col("reason").isNull()
    small = rows.groupBy(_landing_day().alias("day"), "dt", "event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("good"),
        F.count_if(F.array_contains("checks", "schema_valid")).alias("unreadable"),
    )
    return small.agg(
        F.sum("n").alias("bronze"),
        F.sum("good").alias("silver"),
        (F.sum("n") - F.sum("good")).alias("silver_quarantine"),
        F.countDistinct("day").alias("quality"),
        F.count_if(F.col("good") > 0).alias("gold"),
        F.sum("unreadable").alias("gold_quarantine"),
        F.lit(1).alias("runs"),
    )


NODES_SQL = """sizes AS (
  SELECT count(*) AS bronze, count(*) FILTER (WHERE reason IS NULL) AS silver,
         count(*) FILTER (WHERE reason IS NOT NULL) AS silver_quarantine,
         count(DISTINCT strftime(ts, '%Y-%m-%d')) AS quality, (SELECT count(*) FROM gold) AS gold,
         count(*) FILTER (WHERE contains(checks, 'schema_valid')) AS gold_quarantine, 1 AS runs
  FROM cleansed),
nodes AS (
  SELECT 'bronze' AS id, 'bronze' AS zone, 'raw_events' AS kind, bronze AS objects FROM sizes
  UNION ALL SELECT 'silver', 'silver', 'cleansed_events', silver FROM sizes
  UNION ALL SELECT 'silver_quarantine', 'silver', 'quality_quarantine', silver_quarantine FROM sizes
  UNION ALL SELECT 'quality', 'silver', 'quality_report', quality FROM sizes
  UNION ALL SELECT 'gold', 'gold', 'daily_metrics', gold FROM sizes
  UNION ALL SELECT 'gold_quarantine', 'gold', 'rejected_metrics', gold_quarantine FROM sizes
  UNION ALL SELECT 'runs', 'control', 'pipeline_run', runs FROM sizes),
edges AS (
  SELECT e.src, e.dst, e.relation, n.objects AS weight
  FROM (VALUES ('bronze', 'silver', 'cleanse'), ('bronze', 'silver_quarantine', 'reject'), ('silver', 'quality', 'gate'),
               ('quality', 'silver_quarantine', 'quarantine'), ('quality', 'gold', 'aggregate'),
               ('quality', 'gold_quarantine', 'reject'), ('silver', 'gold_quarantine', 'unreadable'),
               ('bronze', 'runs', 'run_metadata'), ('silver', 'runs', 'run_metadata'),
               ('silver_quarantine', 'runs', 'run_metadata'), ('quality', 'runs', 'run_metadata'),
               ('gold', 'runs', 'run_metadata'), ('gold_quarantine', 'runs', 'run_metadata')) AS e(src, dst, relation)
  LEFT JOIN nodes n ON n.id = e.dst),
ratios AS (
  SELECT cut, path, CAST(sum(weight) AS BIGINT) AS weight,
         CAST(sum(sum(weight)) OVER (PARTITION BY cut) AS BIGINT) AS total,
         round(sum(weight) / sum(sum(weight)) OVER (PARTITION BY cut), 4) AS ratio
  FROM (SELECT 'family' AS cut, CASE WHEN relation IN ('cleanse', 'aggregate', 'gate') THEN 'cleanse'
                                     WHEN relation IN ('reject', 'unreadable') THEN 'reject' ELSE relation END AS path, weight
        FROM edges WHERE relation <> 'run_metadata'
        UNION ALL SELECT 'bronze_split', relation, weight FROM edges
        WHERE src = 'bronze' AND relation IN ('cleanse', 'reject')
        UNION ALL SELECT 'quality_split', relation, weight FROM edges
        WHERE src = 'quality' AND relation IN ('aggregate', 'reject', 'quarantine')) AS p
  GROUP BY cut, path)"""


def _graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    nodes = O.nodes_from_counts(_zone_sizes(spark, sf))
    return nodes, O.edge_weights(nodes, O.edge_table(spark))


@report("lineage_nodes", "SELECT id, zone, kind, CAST(objects AS BIGINT) AS objects FROM nodes", NODES_SQL)
def lineage_nodes(spark, sf):
    return _graph(spark, sf)[0]


@report("edge_weights", "SELECT src, dst, relation, CAST(weight AS BIGINT) AS weight FROM edges", NODES_SQL)
def edge_weights(spark, sf):
    return _graph(spark, sf)[1]


@report(
    "quarantine_subgraph",
    """SELECT 'node' AS part, id AS src, CAST(NULL AS VARCHAR) AS dst, kind AS relation, CAST(objects AS BIGINT) AS weight
       FROM nodes WHERE id IN ('silver_quarantine', 'gold_quarantine')
       UNION ALL SELECT 'incoming', src, dst, relation, weight FROM edges WHERE dst IN ('silver_quarantine', 'gold_quarantine')
       UNION ALL SELECT 'outgoing', src, dst, relation, weight FROM edges WHERE src IN ('silver_quarantine', 'gold_quarantine')""",
    NODES_SQL,
)
def quarantine_subgraph(spark, sf):
    return O.quarantine_subgraph(*_graph(spark, sf))


@report(
    "quarantine_totals",
    """SELECT CAST((SELECT sum(objects) FROM nodes WHERE id IN ('silver_quarantine', 'gold_quarantine')) AS BIGINT) AS objects,
              CAST((SELECT sum(weight) FROM edges WHERE dst IN ('silver_quarantine', 'gold_quarantine')) AS BIGINT) AS incoming_weight,
              CAST((SELECT sum(weight) FROM edges WHERE src IN ('silver_quarantine', 'gold_quarantine')) AS BIGINT) AS outgoing_weight""",
    NODES_SQL,
)
def quarantine_totals(spark, sf):
    return O.subgraph_totals(O.quarantine_subgraph(*_graph(spark, sf)))


@report("path_ratios", "SELECT cut, path, weight, total, ratio FROM ratios", NODES_SQL)
def path_ratios(spark, sf):
    return O.path_ratios(_graph(spark, sf)[1])


@report(
    "ratio_alert",
    """SELECT *, family_ok AND bronze_ok AND quality_ok AS ok,
              CASE WHEN family_ok AND bronze_ok AND quality_ok THEN 'ok' ELSE 'breached' END AS status
       FROM (SELECT *, cleanse_share >= 0.60 AS family_ok, bronze_cleanse_share >= 0.80 AS bronze_ok,
                    quality_aggregate_share >= 0.15 AND quality_reject_share <= 0.50 AS quality_ok
             FROM (SELECT max(ratio) FILTER (WHERE cut = 'family' AND path = 'cleanse') AS cleanse_share,
                          max(ratio) FILTER (WHERE cut = 'bronze_split' AND path = 'cleanse') AS bronze_cleanse_share,
                          max(ratio) FILTER (WHERE cut = 'quality_split' AND path = 'aggregate') AS quality_aggregate_share,
                          max(ratio) FILTER (WHERE cut = 'quality_split' AND path = 'reject') AS quality_reject_share
                   FROM ratios) AS s) AS f""",
    NODES_SQL,
)
def ratio_alert(spark, sf):
    return O.ratio_alert(O.path_ratios(_graph(spark, sf)[1]))


# --- maintenance -----------------------------------------------------------

MAINTENANCE_AS_OF = "2024-02-15"


def _inventory(spark, sf) -> DataFrame:
    """Objects per partition of every zone, one object per stored record.

    One pass over the records names each record's Bronze key and its Silver or
    quarantine key; Gold has one object per Silver partition.
    """
    rows = feed.cleansed(spark, sf, ("source_key",))
    ok = F.col("reason").isNull()
    stored = F.struct(
        F.when(ok, "silver.cleaned_events").otherwise("silver.quarantine").alias("dataset"),
        F.when(ok, K.silver_key(F.col("event_type"), F.col("dt"), F.col("event_id")))
        .otherwise(K.silver_quarantine_key(F.col("reason"), F.col("event_id")))
        .alias("path"),
    )
    landed = F.struct(F.lit("bronze.raw_events").alias("dataset"), F.col("source_key").alias("path"))
    keys = rows.select(F.inline(F.array(landed, stored)))
    counted = keys.groupBy(
        "dataset", *[K.hive_value(F.col("path"), c).alias(c) for c in ("reason", "event_type", "dt")]
    ).agg(F.count(F.lit(1)).alias("objects"))
    name = F.concat_ws("/", "reason", "event_type", "dt")
    own = F.struct("dataset", name.alias("partition"), "dt", "objects")
    gold = F.struct(F.lit("gold.daily_metrics").alias("dataset"), name.alias("partition"), F.col("dt"), F.lit(1).cast("bigint").alias("objects"))
    with_gold = F.when(F.col("dataset") == "silver.cleaned_events", F.array(own, gold)).otherwise(F.array(own))
    return counted.select(F.inline(with_gold))


INVENTORY_SQL = """inventory AS (
  SELECT 'bronze.raw_events' AS dataset, strftime(ts, '%Y-%m-%d') AS "partition", strftime(ts, '%Y-%m-%d') AS dt, count(*) AS objects
  FROM cleansed GROUP BY 1, 2, 3
  UNION ALL SELECT 'silver.cleaned_events', event_type || '/' || dt, dt, count(*) FROM silver GROUP BY event_type, dt
  UNION ALL SELECT 'silver.quarantine', reason, NULL, count(*) FROM cleansed WHERE reason IS NOT NULL GROUP BY reason
  UNION ALL SELECT 'gold.daily_metrics', event_type || '/' || dt, dt, 1 FROM gold),
rules AS (
  SELECT * FROM (VALUES ('bronze.raw_events', 30, 8), ('silver.cleaned_events', 20, 52), ('silver.quarantine', 14, 100),
                        ('gold.daily_metrics', 40, 2)) AS r(dataset, days, max_objects)),
planned AS (
  SELECT i.*, r.days, r.max_objects, date_diff('day', CAST(i.dt AS DATE), DATE '2024-02-15') AS age_days,
         strftime(DATE '2024-02-15' - CAST(r.days AS INTEGER), '%Y-%m-%d') AS cutoff,
         i.dt IS NOT NULL AND CAST(i.dt AS DATE) < DATE '2024-02-15' - CAST(r.days AS INTEGER) AS expired,
         i.objects > r.max_objects AS crowded
  FROM inventory i JOIN rules r ON r.dataset = i.dataset)"""

# Days kept and most objects, set so that every outcome occurs in the test data.
DAYS_KEPT = {"bronze.raw_events": 30, "silver.cleaned_events": 20, "silver.quarantine": 14, "gold.daily_metrics": 40}
MOST_OBJECTS = {"bronze.raw_events": 8, "silver.cleaned_events": 52, "silver.quarantine": 100, "gold.daily_metrics": 2}


@report(
    "expire_plan",
    """SELECT dataset, "partition", age_days, cutoff, CASE WHEN expired THEN 'expire' ELSE 'keep' END AS action
       FROM planned WHERE dt IS NOT NULL""",
    INVENTORY_SQL,
)
def expire_plan(spark, sf):
    plan = M.expire_partitions(_inventory(spark, sf), MAINTENANCE_AS_OF, DAYS_KEPT)
    return plan.select("dataset", "partition", "age_days", "cutoff", "action")


@report(
    "object_expire_plan",
    """SELECT source_key, reason,
              round((epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(ts)) / 86400000000.0, 3) AS age_days,
              CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'expire' ELSE 'keep' END AS action
       FROM cleansed WHERE reason IS NOT NULL""",
)
def object_expire_plan(spark, sf):
    bad = C.quarantined(feed.cleansed(spark, sf, ("source_key", "landed_at")))
    stored = bad.select("source_key", "reason", F.col("landed_at").alias("written_at"))
    plan = M.expire_objects(stored, "2024-01-30T00:00:00Z", 14, "silver.quarantine")
    return plan.select("source_key", "reason", "age_days", "action")


@report(
    "compact_plan",
    """SELECT dataset, "partition", objects, CAST(max_objects AS BIGINT) AS max_objects,
              CASE WHEN crowded THEN 'compact' ELSE 'keep' END AS action FROM planned""",
    INVENTORY_SQL,
)
def compact_plan(spark, sf):
    plan = M.compact_plan(_inventory(spark, sf), MOST_OBJECTS)
    return plan.select("dataset", "partition", "objects", "max_objects", "action")


@report(
    "platform_plan",
    """SELECT dataset, count(*) FILTER (WHERE expired) AS expire_count,
              count(*) FILTER (WHERE NOT expired AND crowded) AS compact_count FROM planned GROUP BY dataset""",
    INVENTORY_SQL,
)
def platform_plan(spark, sf):
    return M.plan_counts(M.zone_plan(_inventory(spark, sf), MAINTENANCE_AS_OF, DAYS_KEPT, MOST_OBJECTS))


def _number():
    return F.regexp_extract("source_key", r"evt-(\d+)\.json$", 1).cast("bigint")


def _envelopes(spark, sf, wrapper: str) -> DataFrame:
    """Stored objects in every shape: single, list, envelope, unreadable."""
    n, raw = _number(), F.col("raw")
    text = (
        F.when(n % 50 == 0, "not json")
        .when(n % 3 == 0, F.concat(F.lit("["), raw, F.lit("]")))
        .when(n % 3 == 1, F.concat(F.lit(f'{{"{wrapper}":['), raw, F.lit(","), raw, F.lit("]}")))
        .otherwise(raw)
    )
    return feed.bronze(spark, sf).select(_landing_day().alias("dt"), text.alias("raw"))


ENVELOPE_SQL = """SELECT strftime(ts, '%Y-%m-%d') AS dt,
       CAST(sum(CASE WHEN n % 50 = 0 THEN 0 WHEN n % 3 = 1 THEN 2 ELSE 1 END) AS BIGINT) AS record_count,
       count(*) AS compacted_from
  FROM bronze GROUP BY 1"""


@report("merge_events", ENVELOPE_SQL)
def merge_events(spark, sf):
    return MG.merge_events(_envelopes(spark, sf, "events"), ("dt",))


@report("merge_quarantine", ENVELOPE_SQL)
def merge_quarantine(spark, sf):
    return MG.merge_quarantine(_envelopes(spark, sf, "rejected"), ("dt",))


@report(
    "flattened_events",
    """SELECT strftime(ts, '%Y-%m-%d') AS dt, event_id,
              CAST(sum(CASE WHEN n % 3 = 1 THEN 2 ELSE 1 END) AS BIGINT) AS records
       FROM bronze WHERE n % 50 <> 0 AND event_id <> '' GROUP BY 1, 2""",
)
def flattened_events(spark, sf):
    rows = MG.flatten(_envelopes(spark, sf, "events"), ("dt",), MG.EVENT_LISTS)
    named = rows.select("dt", F.try_variant_get("record", "$.event_id", "string").alias("event_id"))
    kept = named.filter(F.col("event_id").isNotNull() & (F.col("event_id") != ""))
    return kept.groupBy("dt", "event_id").agg(F.count(F.lit(1)).alias("records"))


# --- sources ---------------------------------------------------------------


@report(
    "seed_events",
    """SELECT 'evt-0042-' || lpad(CAST(i AS VARCHAR), CAST(greatest(length(CAST(i AS VARCHAR)), 6) AS INTEGER), '0') AS event_id,
              strftime(TIMESTAMP '2026-01-01 00:00:00' + to_minutes(i), '%Y-%m-%d %H:%M:%S') AS event_ts,
              list_extract(['page_view', 'add_to_cart', 'purchase', 'refund'], CAST(n % 4 + 1 AS INTEGER)) AS event_type,
              'user-' || lpad(CAST((n // 7) % 50 AS VARCHAR), 3, '0') AS user_id,
              list_extract(['SKU-100', 'SKU-200', 'SKU-300', 'SKU-400'], CAST(n % 4 + 1 AS INTEGER)) AS sku,
              n % 5 + 1 AS quantity, round((n % 90 + 10) * 1.25::DOUBLE, 2) AS amount_usd,
              list_extract(['US', 'DE', 'IN', 'BR', 'JP'], CAST(n % 5 + 1 AS INTEGER)) AS country
       FROM (SELECT event_id AS i, (42 * 1103515245::BIGINT + event_id * 12345) & 2147483647 AS n FROM events) AS t""",
    raw_sql=True,
)
def seed_events(spark, sf):
    rows = generator.events_at(feed.events(spark, sf), "event_id", 42)
    return rows.withColumn("event_ts", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss"))


def _messages(spark, sf) -> DataFrame:
    """One notification per event, its shape set by the event number."""
    rows = feed.bronze(spark, sf).select(_number().alias("n"), "landed_at", "source_key")
    return rows.selectExpr(
        "n",
        "landed_at",
        "replace(replace(replace(source_key, '/', '%2F'), '=', '%3D'), 'evt-', 'evt+') AS k",
    ).selectExpr(
        "n",
        "landed_at",
        """CASE n % 5
             WHEN 0 THEN concat('{"Records":[{"eventName":"ObjectCreated:Put","s3":{"bucket":{"name":"land"},"object":{"key":"', k, '"}}}]}')
             WHEN 1 THEN concat('{"Records":[{"eventSource":"aws:sqs","body":"{\\\\"Records\\\\":[{\\\\"s3\\\\":{\\\\"bucket\\\\":{\\\\"name\\\\":\\\\"land\\\\"},\\\\"object\\\\":{\\\\"key\\\\":\\\\"', k, '\\\\"}}}]}"}]}')
             WHEN 2 THEN concat('{"Records":[{"body":{"Records":[{"s3":{"bucket":{"name":"land"},"object":{"key":"', k, '"}}},{"s3":{"bucket":{"name":"copy"},"object":{"key":"', k, '"}}},{"x":1}]}}]}')
             WHEN 3 THEN concat('{"detail-type":"Object Created","detail":{"bucket":{"name":"land"},"object":{"key":"', k, '"}}}')
             ELSE CASE n % 3 WHEN 0 THEN 'not json' WHEN 1 THEN '[]' ELSE '{"hello":"world"}' END
           END AS raw""",
    )


REFS_SQL = """refs AS (
  SELECT n, b.bucket, replace(source_key, 'evt-', 'evt ') AS key,
         CASE n % 5 WHEN 0 THEN 'ObjectCreated:Put' WHEN 3 THEN 'Object Created' ELSE '' END AS event_name,
         CASE n % 5 WHEN 0 THEN 's3' WHEN 3 THEN 'eventbridge' ELSE 'sqs' END AS source
  FROM bronze JOIN (VALUES ('land'), ('copy')) AS b(bucket) ON b.bucket = 'land' OR n % 5 = 2
  WHERE n % 5 <> 4)"""


@report("notification_refs", "SELECT n, bucket, key, event_name, source FROM refs", REFS_SQL)
def notification_refs(spark, sf):
    refs = extract_refs(_messages(spark, sf), keep=("n",))
    return refs.withColumn("event_name", F.coalesce("event_name", F.lit("")))


def _manifest(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Triggered keys (some outside the prefix) and the keys that exist."""
    rows = feed.bronze(spark, sf).select(_number().alias("n"), "source_key")
    inside = F.col("source_key")
    refs = rows.select(F.when(F.col("n") % 9 == 0, F.concat(F.lit("other/"), inside)).otherwise(inside).alias("key"))
    return refs, rows.filter(F.col("n") % 7 != 0).select(inside.alias("key"))


@report(
    "arrivals",
    """SELECT CASE WHEN n % 9 = 0 THEN 'other/' || source_key ELSE source_key END AS key,
              CASE WHEN n % 9 = 0 THEN 'skipped' WHEN n % 7 <> 0 THEN 'accepted' ELSE 'missing' END AS outcome FROM bronze""",
)
def arrivals(spark, sf):
    refs, present = _manifest(spark, sf)
    return objects.arrivals(refs, present)


@report("missing_objects", "SELECT source_key AS key FROM bronze WHERE n % 9 <> 0 AND n % 7 = 0")
def missing_objects(spark, sf):
    refs, present = _manifest(spark, sf)
    inside, _ = objects.split_scope(refs)
    return objects.missing(inside, present)


@report("selected_scope", "SELECT source_key AS key FROM bronze WHERE n % 9 <> 0")
def selected_scope(spark, sf):
    refs, present = _manifest(spark, sf)
    return objects.select_scope(refs, present)


@report(
    "dlq_preview",
    """SELECT CAST(doc_id AS VARCHAR) AS message_id, CAST(1 AS BIGINT) AS receive_count,
              CASE WHEN length(text) > 240 THEN substring(text, 1, 237) || '...' ELSE text END AS body_preview,
              CAST(octet_length(encode(text)) AS BIGINT) AS body_bytes FROM documents""",
    raw_sql=True,
)
def dlq_preview(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    messages = docs.selectExpr("CAST(doc_id AS STRING) AS message_id", "text AS body", "1L AS receive_count")
    return deadletter.summaries(messages)


@report(
    "encode_decode",
    whole_numbers(
        with_ctes(
            """SELECT user_id AS key, event_id, amount_usd + 0.0 AS amount_usd,
              CAST(octet_length(encode('{"event_id":"' || event_id || '","event_ts":"' || strftime(event_ts, '%Y-%m-%dT%H:%M:%S')
                || 'Z","event_type":"' || event_type || '","user_id":"' || user_id || '","amount_usd":' || CAST(amount_usd + 0.0 AS VARCHAR)
                || '}')) AS BIGINT) AS bytes
       FROM silver"""
        )
    ),
    raw_sql=True,
)
def encode_decode(spark, sf):
    """Records of Silver rows, encoded and decoded. A zero amount has no sign, as in `silver_conform`."""
    rows = feed.silver(spark, sf).select("event_id", "event_ts", "event_type", "user_id", "amount_usd")
    sent = records.encode(rows, newline=True)
    text = records.decode(F.col("data"))
    return sent.select(
        "key",
        F.get_json_object(text, "$.event_id").alias("event_id"),
        F.get_json_object(text, "$.amount_usd").cast("double").alias("amount_usd"),
        "bytes",
    )


# --- stored zones and streams ----------------------------------------------


def _stored_silver(spark, sf, rebalance: bool = True) -> str:
    path = scratch_path(spark, "silver")
    rows = feed.silver(spark, sf, ("landed_at",)).select(*SILVER_SCHEMA.names)
    sinks.write_partitions(rows, path, ("event_type", "dt"), rebalance)
    return path


def _stored_gold(spark, sf) -> str:
    path = scratch_path(spark, "gold")
    sinks.write_gold(G.daily_metrics(feed.silver(spark, sf), ordered=False), path)
    return path


@report("zone_inventory", "SELECT event_type, dt, true AS stored FROM gold")
def zone_inventory(spark, sf):
    listed = objects.inventory(spark, _stored_silver(spark, sf), "*.parquet")
    counted = PT.objects_per_partition(listed, ("event_type", "dt"))
    return counted.select("event_type", "dt", (F.col("objects") > 0).alias("stored"))


@report(
    "json_landing",
    "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS records FROM cleansed GROUP BY 1",
)
def json_landing(spark, sf):
    """Bronze landed as JSON lines by day, one batch of it twice, and read back tolerantly."""
    path = scratch_path(spark, "bronze-json")
    landed = feed.bronze(spark, sf).withColumn("dt", _landing_day())
    early = F.col("dt") <= "2024-01-10"
    for batch, rows in (("1", landed.filter(early)), ("2", landed.filter(~early)), ("1", landed.filter(early))):
        sinks.write_bronze(rows, path, "text", batch)
    rows = C.inspect(objects.read_json_lines(spark, path, "*.txt"), keep=(), gate=False)
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("records"))


@report(
    "sample_gold",
    """SELECT event_type || '#' || dt AS metric_day, events, amount_usd, event_type AS metric, dt FROM gold
       ORDER BY 1 LIMIT 50""",
)
def sample_gold(spark, sf):
    return sinks.sample_gold(spark, _stored_gold(spark, sf), 50)


@report("catalog_table", "SELECT event_type AS metric, dt, events, amount_usd FROM gold")
def catalog_table(spark, sf):
    """Gold through an external table with partition columns metric and dt."""
    location = _stored_gold(spark, sf)
    name = catalog.create_table(spark, GOLD_CONTRACT, location, {"metric": "event_type"}, database="tidemark_query")
    return spark.table(name).select("metric", "dt", "events", "amount_usd")


@report(
    "quality_reports",
    """SELECT 'run-1' AS run_id, rows_failed = 0 AS passed, CASE WHEN rows_failed > 0 THEN 'quarantine' ELSE 'pass' END AS action,
              rows_scanned, rows_failed, round(rows_failed / rows_scanned, 4) AS fail_ratio, '2024-01-30' AS dt FROM tally""",
    QUALITY_TALLY_SQL,
)
def quality_reports(spark, sf):
    path = scratch_path(spark, "reports")
    tallied = Q.tally(Q.with_checks(feed.silver(spark, sf)))
    sinks.write_report(Q.report(tallied, "run-1", "quarantine"), path, feed.AS_OF)
    return sinks.recent_reports(spark, path).drop("checks", "report_key")


@report(
    "gated_run",
    """SELECT event_type AS metric, dt, count(*) AS events, round(sum(amount_usd), 2) AS amount_usd
       FROM silver WHERE user_id <> '' GROUP BY event_type, dt""",
)
def gated_run(spark, sf):
    """All zones in one gated run; the clean subset goes on to Gold."""
    root = scratch_path(spark, "run")
    flow.run_batch(spark, feed.bronze(spark, sf), root, feed.WATERMARK, on_fail="quarantine", promote_clean=True)
    return sinks.read_gold(spark, f"{root}/gold/metrics").drop("metric_day")


@report(
    "incremental_run",
    """SELECT event_type AS metric, dt, count(*) AS events, round(sum(amount_usd), 2) AS amount_usd
       FROM silver WHERE user_id <> '' GROUP BY event_type, dt""",
)
def incremental_run(spark, sf):
    """The same events in two batches that share days and some ids: Gold as after one batch."""
    root = scratch_path(spark, "run")
    bronze = materialize(feed.bronze(spark, sf), "bronze")
    late = F.pmod(F.xxhash64("source_key"), F.lit(3)) == 0
    shared = F.pmod(F.xxhash64("source_key"), F.lit(10)) == 0
    for batch in (bronze.filter(~late), bronze.filter(late | shared)):
        flow.run_batch(spark, batch, root, feed.WATERMARK, on_fail="quarantine", promote_clean=True)
    return sinks.read_gold(spark, f"{root}/gold/metrics").drop("metric_day")


@report(
    "gate_blocks",
    """SELECT event_type AS metric, dt, count(*) AS events, round(sum(amount_usd), 2) AS amount_usd
       FROM silver WHERE dt > '2024-01-15'
       GROUP BY event_type, dt HAVING count_if(user_id = '') = 0""",
)
def gate_blocks(spark, sf):
    """Batches by day range: refused ones never reach Gold, later clean ones do not bring them in."""
    root = scratch_path(spark, "run")
    silver = feed.cleansed(spark, sf, keep=("source_key", "landed_at"), gate=True)
    bronze = materialize(feed.bronze(spark, sf), "bronze")
    days = F.regexp_extract("source_key", "dt=([0-9-]+)", 1)
    flow.run_batch(spark, bronze.filter(days <= "2024-01-15"), root, feed.WATERMARK, on_fail="fail")
    faulty = materialize(
        silver.filter("reason IS NULL AND size(checks) > 0").select("event_type", "dt").distinct(), "faulty"
    )
    typed = materialize(C.accepted(silver).filter("dt > '2024-01-15'").select("event_type", "dt", "source_key"), "typed")
    clean = typed.join(faulty, ["event_type", "dt"], "left_anti").select("source_key")
    flow.run_batch(spark, bronze.join(clean, "source_key", "left_semi"), root, feed.WATERMARK, on_fail="fail")
    return sinks.read_gold(spark, f"{root}/gold/metrics").drop("metric_day")


@report(
    "compact_apply",
    "SELECT event_type, dt, count(*) AS events, true AS compacted FROM silver GROUP BY event_type, dt",
)
def compact_apply(spark, sf):
    """Silver written in fragments, then compacted: same rows, fewer objects."""
    path = _stored_silver(spark, sf, rebalance=False)
    before = materialize(PT.objects_per_partition(objects.inventory(spark, path), ("event_type", "dt")), "before")
    upkeep.compact(spark, path, M.compact_plan(before, 1, "silver.cleaned_events"))
    after = PT.objects_per_partition(objects.inventory(spark, path), ("event_type", "dt"))
    rows = spark.read.schema(SILVER_SCHEMA).parquet(path).groupBy("event_type", "dt").agg(F.count(F.lit(1)).alias("events"))
    sizes = before.select("event_type", "dt", F.col("objects").alias("had")).join(after, ["event_type", "dt"])
    fewer = (F.col("objects") < F.col("had")) | (F.col("had") == 1)
    return rows.join(sizes, ["event_type", "dt"]).select("event_type", "dt", "events", fewer.alias("compacted"))


@report("expire_apply", "SELECT event_type, dt, count(*) AS events FROM silver WHERE dt >= '2024-01-26' GROUP BY event_type, dt")
def expire_apply(spark, sf):
    """Silver after deleting the days past retention."""
    path = _stored_silver(spark, sf)
    plan = upkeep.partition_plan(spark, path, "silver.cleaned_events", MAINTENANCE_AS_OF, 20)
    upkeep.expire(spark, path, plan)
    return spark.read.schema(SILVER_SCHEMA).parquet(path).groupBy("event_type", "dt").agg(F.count(F.lit(1)).alias("events"))


@report(
    "redrive",
    """SELECT count(*) - least(count(*), 10) AS waiting, least(count(*), 10) AS moved FROM bronze WHERE n % 5 = 4""",
)
def redrive(spark, sf):
    """Poison messages parked as dead letters, one batch sent back."""
    root = scratch_path(spark, "dead-letters")
    poison = _messages(spark, sf).filter(F.col("n") % 5 == 4)
    parked = poison.select(
        F.col("n").cast("string").alias("message_id"), F.col("raw").alias("body"),
        F.lit(1).cast("bigint").alias("receive_count"), F.col("landed_at").alias("enqueued_at"),
    )
    deadletter.append(parked, root)
    deadletter.redrive(spark, root, f"{root}/source")
    returned = spark.read.parquet(f"{root}/source").agg(F.count(F.lit(1)).alias("moved"))
    left = deadletter.waiting(spark, root).agg(F.count(F.lit(1)).alias("waiting"))
    return left.select("waiting", returned.scalar().alias("moved"))


@report(
    "stream_drain",
    """SELECT source, count(*) AS records FROM refs GROUP BY source
       UNION ALL SELECT 'dead_letter', count(*) FROM bronze WHERE n % 5 = 4 AND n % 3 <> 2
       UNION ALL SELECT 'messages', count(*) FROM bronze
       UNION ALL SELECT 'failed alone', count(*) FROM bronze WHERE n % 5 = 4 AND n % 3 <> 2
       UNION ALL SELECT 'most in an invocation', least(count(*), 10) FROM bronze""",
    REFS_SQL,
)
def stream_drain(spark, sf):
    """Notifications drained as a stream into references and dead letters."""
    root = scratch_path(spark, "drain")
    _messages(spark, sf).select("raw").write.option("maxRecordsPerFile", 10_000).text(f"{root}/queue")
    messages = jobs.message_stream(spark, f"{root}/queue")
    jobs.drain_messages(messages, f"{root}/refs", f"{root}/dlq", f"{root}/checkpoint").awaitTermination()
    refs = spark.read.parquet(f"{root}/refs").groupBy("source").agg(F.count(F.lit(1)).alias("records"))
    dead = deadletter.waiting(spark, f"{root}/dlq").agg(F.count(F.lit(1)).alias("records"))
    invocations = spark.read.parquet(f"{root}/refs-invocations").agg(
        F.sum("messages").alias("messages"), F.sum("failed").alias("failed alone"), F.max("messages").alias("most in an invocation")
    )
    counted = invocations.unpivot([], invocations.columns, "source", "records")
    return refs.unionByName(dead.select(F.lit("dead_letter").alias("source"), "records")).unionByName(counted)


@report("stream_bronze", "SELECT dt, count(*) AS events FROM silver GROUP BY dt")
def stream_bronze(spark, sf):
    """Records published to a folder and delivered to Bronze by day."""
    root = scratch_path(spark, "delivery")
    records.publish(feed.silver(spark, sf).drop("_late", "dt"), f"{root}/source")
    stream = jobs.record_stream(spark, f"{root}/source")
    jobs.deliver_bronze(stream, f"{root}/bronze", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/bronze").groupBy("dt").agg(F.count(F.lit(1)).alias("events"))


def _queue(spark, sf, root: str, repeats: bool) -> None:
    """Bronze rows of the feed in a folder that streams read, by slice."""
    sliced = feed.with_slices(feed.dealt(feed.events(spark, sf)), repeats)
    sliced.write.partitionBy("slice").parquet(f"{root}/queue")


def _arriving(spark, root: str) -> DataFrame:
    """The queue as a stream, about one slice a batch."""
    files = len(spark.read.parquet(f"{root}/queue").inputFiles())
    source = spark.readStream.schema(f"{BRONZE_SCHEMA}, slice BIGINT").option("maxFilesPerTrigger", -(-files // feed.SLICES))
    return source.parquet(f"{root}/queue").drop("slice")


def _streamed(spark, sf, repeats: bool) -> str:
    root = scratch_path(spark, "stream")
    _queue(spark, sf, root, repeats)
    jobs.silver_stream(_arriving(spark, root), root, f"{root}/checkpoint/silver", feed.WATERMARK).awaitTermination()
    return root


AMENDED_SQL = """amended AS (
  SELECT n, event_type, dt, _late, CASE WHEN n % 7 = 0 THEN amount_usd + 1 ELSE amount_usd END AS amount_usd FROM silver)"""


@report(
    "stream_silver",
    """SELECT event_type, dt, count(*) AS events, count(*) FILTER (WHERE _late) AS late_events,
              round(sum(amount_usd), 2) AS amount_usd FROM amended GROUP BY event_type, dt""",
    AMENDED_SQL,
)
def stream_silver(spark, sf):
    """Silver of four batches with late, repeated and overwritten events: the last write of each."""
    silver = jobs.latest_silver(spark, _streamed(spark, sf, repeats=True))
    return silver.groupBy("event_type", "dt").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("_late").alias("late_events"),
        F.round(F.sum("amount_usd"), 2).alias("amount_usd"),
    )


@report(
    "stream_gold",
    "SELECT event_type AS metric, dt, count(*) AS events, round(sum(amount_usd), 2) AS amount_usd FROM amended GROUP BY 1, 2",
    AMENDED_SQL,
)
def stream_gold(spark, sf):
    """Gold kept by partial sums over four or more batches of Silver files, some rows retracted."""
    root = _streamed(spark, sf, repeats=True)
    files = objects.inventory(spark, f"{root}/silver/events", "*.parquet").count()
    jobs.gold_stream(spark, root, f"{root}/checkpoint/gold", files_per_batch=max(1, -(-files // 4))).awaitTermination()
    return sinks.read_gold(spark, f"{root}/gold/metrics").drop("metric_day")


@report(
    "stream_replay",
    """SELECT 'silver' AS part, count(*) AS records FROM silver
       UNION ALL SELECT 'quarantine', count(*) FROM cleansed WHERE reason IS NOT NULL
       UNION ALL SELECT 'gold', count(*) FROM silver
       UNION ALL SELECT 'batches succeeded', count(DISTINCT n % 4) FROM bronze
       UNION ALL SELECT 'batches attempted twice', 1
       UNION ALL SELECT 'gold fresh', count(*) FROM silver""",
)
def stream_replay(spark, sf):
    """Batches delivered twice, one of them after an attempt that died half-way: every table as if once."""
    root = scratch_path(spark, "stream")
    _queue(spark, sf, root, repeats=False)

    def die(number: int, step: str) -> None:
        if (number, step) == (1, "silver"):
            raise RuntimeError("the attempt ends here")

    first = f"{root}/checkpoint/silver"
    failed = jobs.silver_stream(_arriving(spark, root), root, first, feed.WATERMARK, interrupt=die)
    try:
        failed.awaitTermination()
    except StreamingQueryException:
        pass
    for checkpoint in (first, f"{root}/checkpoint/again"):
        jobs.silver_stream(_arriving(spark, root), root, checkpoint, feed.WATERMARK).awaitTermination()
    jobs.gold_stream(spark, root, f"{root}/checkpoint/gold").awaitTermination()
    runs = sinks.read_runs(spark, f"{root}/runs")
    batches = runs.filter("step = 'silver'").groupBy("run_id").agg(
        F.count_if(F.col("status") == "running").alias("begun"), F.count_if(F.col("status") == "succeeded").alias("done")
    )
    fresh = F.sum(F.get_json_object("metrics", "$.fresh").cast("bigint"))
    parts = {
        "silver": jobs.current_silver(spark, root).agg(F.count(F.lit(1)).alias("records")),
        "quarantine": spark.read.parquet(f"{root}/silver/quarantine").agg(F.count(F.lit(1)).alias("records")),
        "gold": sinks.read_gold(spark, f"{root}/gold/metrics").agg(F.sum("events").alias("records")),
        "batches succeeded": batches.agg(F.count_if(F.col("done") == 1).alias("records")),
        "batches attempted twice": batches.agg(F.count_if(F.col("begun") == 2).alias("records")),
        "gold fresh": runs.filter("step = 'gold'").agg(fresh.alias("records")),
    }
    shown = [frame.select(F.lit(name).alias("part"), "records") for name, frame in parts.items()]
    return reduce(DataFrame.unionByName, shown)


def _posted(spark, sf) -> DataFrame:
    """Event texts of the feed, some that are no event and some with a long note."""
    note = ',"note":"' + "x" * 400 + '"}'
    n, raw = _number(), F.col("raw")
    text = F.when(n % 29 == 0, "not json").when(
        (n % 31 == 0) & (raw != "{}"), F.concat(raw.substr(F.lit(1), F.length(raw) - 1), F.lit(note))
    )
    return feed.bronze(spark, sf).select(text.otherwise(raw).alias("raw"))


@report(
    "stream_produce",
    """SELECT sink, name, CAST(value AS BIGINT) AS value, CAST(CASE name WHEN 'sent' THEN value WHEN 'failed' THEN value END AS BIGINT) AS stored
       FROM (SELECT count(*) AS total, count(*) FILTER (WHERE n % 29 = 0 OR event_id = '') AS undecodable,
                    count(*) FILTER (WHERE n % 29 <> 0 AND event_id <> '' AND n % 31 = 0) AS oversized FROM bronze) AS c,
            (VALUES ('records'), ('delivery')) AS s(sink),
            LATERAL (VALUES ('sent', total - undecodable - oversized), ('failed', undecodable + oversized),
                            ('undecodable', undecodable), ('oversized', oversized)) AS v(name, value)""",
)
def stream_produce(spark, sf):
    """Events published to two sinks in batches: the counts of the run log, beside those of what is stored."""
    root = scratch_path(spark, "produce")
    _posted(spark, sf).write.parquet(f"{root}/posted")
    files = len(spark.read.parquet(f"{root}/posted").inputFiles())
    posted = spark.readStream.schema("raw STRING").option("maxFilesPerTrigger", max(1, -(-files // 4))).parquet(f"{root}/posted")
    limits = {"records": 400, "delivery": 400}
    producer.produce(posted, root, f"{root}/checkpoint", limits).awaitTermination()
    logged = R.counters(R.latest_versions(sinks.read_runs(spark, f"{root}/runs")))
    sums = logged.groupBy(
        F.substring_index("name", ".", 1).alias("sink"), F.substring_index("name", ".", -1).alias("name")
    ).agg(F.sum(F.col("value").cast("bigint")).alias("value"))
    stored = [
        producer.sent(spark, root, sink).groupBy(F.lit(sink).alias("sink"), F.col("outcome").alias("name")).agg(F.count(F.lit(1)).alias("stored"))
        for sink in limits
    ]
    return sums.filter("name <> 'bytes'").join(reduce(DataFrame.unionByName, stored), ["sink", "name"], "left")


@report(
    "freshness_sources",
    """SELECT 'gold' AS state, 'gold' AS source, CAST(NULL AS VARCHAR) AS last_written, CAST(NULL AS DOUBLE) AS age_hours, 'ok' AS status
       UNION ALL SELECT 'runs', 'runs', strftime(max(finished_at), '%Y-%m-%d %H:%M:%S'),
              round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(finished_at))) / 3600000000.0, 3),
              CASE WHEN epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(finished_at)) <= 86400000000 THEN 'ok' ELSE 'breached' END
       FROM days
       UNION ALL SELECT 'neither', 'none', NULL, NULL, 'unknown'""",
    DAY_RUNS_SQL,
)
def freshness_sources(spark, sf):
    """Last write of Gold: by its files, by the run log where Gold holds nothing, or unknown."""
    root = scratch_path(spark, "fresh")
    for name in ("gold", "runs"):
        runs = _zone_runs(spark, sf).select("run_id", "status", "started_at", "finished_at", "metrics")
        sinks.append_runs(runs, f"{root}/{name}/runs")
    sinks.write_gold(G.daily_metrics(feed.silver(spark, sf), ordered=False), f"{root}/gold/gold/metrics")
    # Files of now are as old as the query; their instant is left out of the result.
    shown = F.when(F.col("source") == "runs", F.date_format("last_written", "yyyy-MM-dd HH:mm:ss"))
    parts = []
    for name in ("gold", "runs", "neither"):
        as_of = datetime.now(tz=timezone.utc) if name == "gold" else "2024-02-01T00:00:00Z"
        found = O.gold_freshness(spark, f"{root}/{name}", as_of)
        age = F.when(F.col("source") == "runs", F.col("age_hours")).alias("age_hours")
        parts.append(found.select(F.lit(name).alias("state"), "source", shown.alias("last_written"), age, "status"))
    return reduce(DataFrame.unionByName, parts)


PLATFORM_SQL = """zones AS (
  SELECT 'bronze.raw_events' AS dataset, strftime(ts, '%Y-%m-%d') AS dt, '' AS name, count(*) AS records FROM cleansed GROUP BY 2
  UNION ALL SELECT 'silver.cleaned_events', dt, event_type, count(*) FROM silver GROUP BY dt, event_type
  UNION ALL SELECT 'silver.quarantine', NULL, reason, count(*) FROM cleansed WHERE reason IS NOT NULL GROUP BY reason
  UNION ALL SELECT 'gold.daily_metrics', dt, event_type, 1 FROM gold
  UNION ALL SELECT 'gold.quarantine', strftime(ts, '%Y-%m-%d'), event_type, 1 FROM bronze WHERE event_type = 'error' GROUP BY 2, 3),
kept AS (
  SELECT *, dt IS NOT NULL AND CAST(dt AS DATE) < DATE '2024-04-05' - CAST(CASE dataset
              WHEN 'bronze.raw_events' THEN 80 WHEN 'silver.cleaned_events' THEN 75 WHEN 'gold.daily_metrics' THEN 90 ELSE 70 END AS INTEGER)
            AS expired FROM zones)"""


@report(
    "platform_maintain",
    """SELECT dataset, count(*) FILTER (WHERE expired) AS expire_count, count(*) FILTER (WHERE expired) AS deleted_count,
              CAST(coalesce(sum(records) FILTER (WHERE NOT expired), 0) AS BIGINT) AS records_left, true AS compacted FROM kept GROUP BY dataset
       UNION ALL SELECT 'all zones', count(*) FILTER (WHERE expired), count(*) FILTER (WHERE expired),
              CAST(sum(records) FILTER (WHERE NOT expired) AS BIGINT), true FROM kept""",
    PLATFORM_SQL,
)
def platform_maintain(spark, sf):
    """Five stored zones expired, then compacted, and their counters summed; every record left is there once."""
    root = scratch_path(spark, "platform")
    rows = materialize(feed.cleansed(spark, sf, ("source_key", "landed_at", "raw"), gate=True), "platform-rows")
    for part in range(2):  # fragments in every partition
        half = rows.filter(F.pmod(F.xxhash64("source_key"), F.lit(2)) == part)
        landed = half.select("raw", "source_key", "landed_at", _landing_day().alias("dt"))
        sinks.append_partitions(landed, f"{root}/bronze/events", ("dt",))
        sinks.append_partitions(C.accepted(half).select(*SILVER_SCHEMA.names), f"{root}/silver/events", ("event_type", "dt"))
        sinks.write_silver_quarantine(C.quarantined(half), f"{root}/silver/quarantine", f"run-{part}")
    typed = rows.filter("reason IS NULL").unionByName(
        feed.events(spark, sf).filter("event_type = 'error'").select(
            F.col("event_type"), F.date_format("ts", "yyyy-MM-dd").alias("dt"), F.lit(1.0).alias("amount_usd")
        ),
        allowMissingColumns=True,
    )
    sinks.publish_metrics(G.daily_metrics(typed, ordered=False), root, "run-1")
    days = {"bronze.raw_events": 80, "silver.cleaned_events": 75, "silver.quarantine": 36500, "gold.daily_metrics": 90, "gold.quarantine": 70}
    reports = upkeep.maintain_platform(spark, root, "2024-04-05", apply=True, retention_days=days, max_objects=dict.fromkeys(days, 1))
    zones = reports.join(upkeep.zone_sizes(spark, root), "dataset")
    shown = zones.select(
        "dataset", "expire_count", "deleted_count", F.col("records").alias("records_left"), (F.col("crowded") == 0).alias("compacted")
    )
    left = zones.agg(F.sum("records").alias("records"), (F.sum("crowded") == 0).alias("compacted"))
    total = upkeep.platform_totals(reports).select(
        F.lit("all zones").alias("dataset"),
        "expire_count",
        "deleted_count",
        left.select("records").scalar().alias("records_left"),
        left.select("compacted").scalar().alias("compacted"),
    )
    return shown.unionByName(total)
