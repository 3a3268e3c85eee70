"""The gated run: land, cleanse, gate, aggregate, record."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cleanse as C
from tidemark.operators import gold as G
from tidemark.operators import late as L
from tidemark.operators import quality as Q
from tidemark.operators.identity import manifest_identity
from tidemark.operators.runs import run_record
from tidemark.schemas import DEFAULT_LOOKBACK_DAYS, SUCCESS_STATUSES
from tidemark.session import materialize
from tidemark.sources import sinks
from tidemark.sources.notifications import extract_refs
from tidemark.sources.objects import arrivals


def reconcile(cleansed: DataFrame) -> DataFrame:
    """One row of stage counts of a closed batch, and whether they agree.

    Gold events are summed from the daily metrics, so the row shows that the
    aggregation lost nothing.
    """
    stages = cleansed.agg(
        F.count(F.lit(1)).alias("seeded"),
        F.count_if(F.col("reason").isNull()).alias("valid"),
        F.count_if(F.col("reason").isNotNull()).alias("quarantined"),
        F.count_if(F.col("reason").isNull() & (F.size("checks") > 0)).alias("gate_failures"),
    )
    metrics = G.daily_metrics(C.accepted(cleansed), ordered=False)
    totals = metrics.agg(F.count(F.lit(1)).alias("gold"), F.coalesce(F.sum("events"), F.lit(0)).alias("gold_events"))
    row = stages.select(
        "*",
        totals.select("gold").scalar().alias("gold"),
        totals.select("gold_events").scalar().alias("gold_events"),
    )
    return row.withColumns(
        {
            "gate_passed": F.col("gate_failures") == 0,
            "gold_matches_silver": F.col("gold_events") == F.col("valid"),
            "balanced": F.col("seeded") == F.col("valid") + F.col("quarantined"),
        }
    )


#: Lookback of a batch that is closed: nothing in it is late.
CLOSED_LOOKBACK_DAYS = 3650


def closed_batch(bronze: DataFrame) -> DataFrame:
    """Stage counts of a batch on its own, without sinks; its watermark is a minute past its latest event."""
    rows = materialize(C.inspect(bronze, gate=True).drop("raw"), "closed")
    watermark = rows.agg((F.max(F.when(F.col("reason").isNull(), F.col("event_ts"))) + F.expr("INTERVAL 1 MINUTE")).alias("at")).first()["at"]
    mark = F.lit(watermark).cast("timestamp")
    flagged = rows.withColumn("_late", F.when(F.col("reason").isNull(), C.late_flag(F.col("event_ts"), mark, CLOSED_LOOKBACK_DAYS)))
    late = flagged.agg(F.count_if("_late").alias("late"))
    return reconcile(flagged).select("*", late.scalar().alias("late"), mark.alias("watermark"))


def ingest(spark: SparkSession, messages: DataFrame, present: DataFrame, root: str, prefix: str = "events/") -> dict:
    """Check the objects that notifications name and record the arrival run.

    ``messages`` holds notification texts, ``present`` the keys that exist. The
    run fails when every object is missing; a run over the same objects that
    already succeeded is replayed.
    """
    started = datetime.now(tz=timezone.utc)
    outcome = materialize(arrivals(extract_refs(messages).select("bucket", "key"), present, prefix), "arrivals")
    counts = outcome.agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(F.col("outcome") == name).alias(name) for name in ("accepted", "skipped", "missing")],
    ).first()
    absent = F.col("outcome") == "missing"
    part = F.when(absent, F.concat(F.lit("missing:"), "bucket", F.lit("/"), "key")).otherwise(F.col("key"))
    parts = outcome.filter(F.col("outcome") != "skipped").select(part.alias("part"))
    identity = manifest_identity(parts, (), "part", "bronze").first()
    result = {"run_id": identity["run_id"], **counts.asDict()}
    runs_path = f"{root}/runs"
    if _succeeded(spark, runs_path, identity["run_id"]):
        return {**result, "status": "succeeded", "replay": True}
    status = "failed" if counts["missing"] and not counts["accepted"] else "succeeded"
    error = f"missing bronze objects: {counts['missing']}" if status == "failed" else None
    metrics = {"object_count": counts["accepted"], "missing": counts["missing"]}
    record = run_record(
        spark, identity["run_id"], status, started, "bronze", "ingest", datetime.now(tz=timezone.utc),
        error=error, object_count=counts["accepted"], metrics=_as_json(metrics),
    )
    sinks.append_runs(record, runs_path)
    return {**result, "status": status, "replay": False}


def run_batch(
    spark: SparkSession,
    bronze: DataFrame,
    root: str,
    watermark: datetime | str | None = None,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    on_fail: str = "fail",
    max_fail_ratio: float = 0.0,
    promote_clean: bool = False,
) -> dict:
    """Run all zones over a Bronze frame; Gold is written only past the gate.

    ``promote_clean`` sends the rows that pass every check on to Gold when the
    gate quarantines. A run over the same objects that already succeeded is
    replayed: nothing is written.
    """
    started = datetime.now(tz=timezone.utc)
    runs_path = f"{root}/runs"
    identity = manifest_identity(bronze, (), "source_key", "silver").first()
    run_id = identity["run_id"]
    previous = _succeeded(spark, runs_path, run_id)
    if previous is not None:
        return {"run_id": run_id, "status": previous, "replay": True}

    rows = C.cleanse(bronze, watermark, lookback_days, gate=True)
    rows = rows.withColumn("raw", F.when(F.col("reason").isNotNull() | (F.size("checks") > 0), F.col("raw")))
    staged = materialize(rows, "cleansed")
    valid = staged.filter(F.col("reason").isNull())
    touched = sinks.upsert_silver(C.accepted(staged), f"{root}/silver/events")
    # The gate judges what Gold would read: all rows of the partitions that this run touched.
    stored = sinks.read_silver(spark, f"{root}/silver/events") if not touched.isEmpty() else None
    silver = Q.with_checks(C.accepted(staged) if stored is None else sinks.only_partitions(stored, touched, ("event_type", "dt")))

    report = materialize(Q.report(Q.tally(silver), run_id, on_fail, max_fail_ratio), "report")
    sinks.write_report(report, f"{root}/silver/quality", started.date().isoformat())
    gate = report.first()
    refused = C.quarantined(staged)
    if gate["action"] == "quarantine":
        refused = refused.unionByName(Q.failing(valid), allowMissingColumns=True)
    sinks.write_silver_quarantine(refused, f"{root}/silver/quarantine", run_id)

    counts = staged.agg(
        F.count_if(F.col("reason").isNull()).alias("valid"),
        F.count_if(F.col("reason").isNotNull()).alias("quarantined"),
        F.count_if("_late").alias("late"),
        F.max("event_ts").alias("latest_event_ts"),
    ).first()

    status, gold_rows = "succeeded", 0
    if not gate["passed"] and gate["action"] == "fail":
        status = "quality_failed"
    if gate["passed"]:
        gold_rows = write_gold_zone(silver, root, run_id)
    elif gate["action"] == "quarantine" and promote_clean:
        gold_rows = write_gold_zone(Q.passing(silver), root, run_id)

    metrics = {
        "valid": counts["valid"],
        "quarantined": counts["quarantined"],
        "late": counts["late"],
        "rows_scanned": gate["rows_scanned"],
        "rows_failed": gate["rows_failed"],
        "gold_written": gold_rows,
    }
    failed = [check["check_name"] for check in gate["checks"] if not check["passed"]]
    error = f"quality gate failed: {', '.join(failed)}" if status == "quality_failed" else None
    record = run_record(
        spark, run_id, status, started, "silver", "pipeline", datetime.now(tz=timezone.utc),
        error=error, object_count=identity["parts"], metrics=_as_json(metrics),
    )
    sinks.append_runs(record, runs_path)
    return {"run_id": run_id, "status": status, "replay": False, "passed": gate["passed"], "action": gate["action"], **metrics}


def write_gold_zone(silver: DataFrame, root: str, run_id: str) -> int:
    """Aggregate, split by contract, write metrics and rejects; rows accepted."""
    return sinks.publish_metrics(G.daily_metrics(silver, ordered=False), root, run_id)[0]


def reprocess(
    spark: SparkSession, root: str, as_of, lookback_days: int = DEFAULT_LOOKBACK_DAYS
) -> dict:
    """Rebuild Gold for the lookback window and record the run."""
    started = datetime.now(tz=timezone.utc)
    silver = sinks.read_silver(spark, f"{root}/silver/events")
    report = L.window_report(silver, as_of, lookback_days).first().asDict()
    run_id = f"gold-reprocess-{report['window_start']}-{report['window_end']}"
    rebuilt = L.rebuild_window(silver, as_of, lookback_days)
    report["gold_written"], report["rejected"] = sinks.publish_metrics(rebuilt, root, run_id)
    record = run_record(
        spark, run_id, "succeeded", started, "gold", "reprocess", datetime.now(tz=timezone.utc), metrics=_as_json(report)
    )
    sinks.append_runs(record, f"{root}/runs")
    return {"run_id": run_id, "status": "succeeded", **report}


def _succeeded(spark: SparkSession, path: str, run_id: str) -> str | None:
    try:
        runs = sinks.read_runs(spark, path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    row = runs.filter((F.col("run_id") == run_id) & F.col("status").isin(*SUCCESS_STATUSES)).first()
    return row["status"] if row else None


def _as_json(values: dict) -> str:
    import json

    return json.dumps(values, default=str)
