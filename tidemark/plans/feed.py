"""Bronze records derived from an `events` table, with known faults.

The table holds clicks, views, purchases, signups and errors. Each row becomes
one raw JSON text; rows whose id is a multiple of a fault's number carry that
fault, so every rejection reason occurs at a known rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cleanse as C
from tidemark.operators.gold import daily_metrics
from tidemark.schemas import SILVER_SCHEMA
from tidemark.session import scratch_path
from tidemark.sources import sinks

# Fixed parameters of the derived data set.
WATERMARK = "2024-01-16T00:00:00Z"
AS_OF = "2024-01-30"
LOOKBACK_DAYS = 2

EVENTS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def with_bronze(events_df: DataFrame, *keep: str, offset: str = "0") -> DataFrame:
    """raw, source_key and landed_at of the rows of an events table.

    ``offset`` is an SQL expression of the whole hours by which an event's local time is
    ahead of UTC.
    """
    padded = "lpad(CAST(event_id AS STRING), greatest(length(CAST(event_id AS STRING)), 8), '0')"
    stamp = """date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")"""
    if offset != "0":
        local = f"""date_format(ts + make_dt_interval(0, {offset}), "yyyy-MM-dd'T'HH:mm:ss")"""
        stamp = f"concat({local}, CASE WHEN {offset} < 0 THEN '-' ELSE '+' END, lpad(abs({offset}), 2, '0'), ':00')"
    text = f"""concat(
        '{{"event_id":"', CASE WHEN event_id % 97 = 0 THEN '' ELSE concat('evt-', {padded}) END,
        '","event_ts":"', CASE WHEN event_id % 107 = 0 THEN 'not-a-timestamp'
                               ELSE {stamp} END,
        '","event_type":"', CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart'
                                            WHEN 'signup' THEN 'refund' ELSE event_type END,
        '","user_id":"', CASE WHEN event_id % 109 = 0 THEN '' ELSE concat('user-',
              lpad(CAST(user_id AS STRING), greatest(length(CAST(user_id AS STRING)), 4), '0')) END,
        '","sku":"SKU-', (event_id % 4 + 1) * 100,
        '","quantity":', CASE WHEN event_id % 101 = 0 THEN '"two"'
                              ELSE CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 6 AS STRING) END,
        ',"amount_usd":', CASE WHEN event_id % 103 = 0 THEN -value ELSE value END,
        ',"country":"', element_at(array('US', 'DE', 'IN', 'BR', 'JP'), CAST(user_id % 5 + 1 AS INT)),
        '"}}')"""
    return events_df.selectExpr(
        f"CASE WHEN event_id % 113 = 0 THEN '{{}}' ELSE {text} END AS raw",
        f"concat('events/dt=', date_format(ts, 'yyyy-MM-dd'), '/evt-', {padded}, '.json') AS source_key",
        "CAST(ts AS TIMESTAMP) AS landed_at",
        *keep,
    )


SLICES = 4


def with_slices(events_df: DataFrame, repeats: bool = False) -> DataFrame:
    """Bronze rows dealt into the column `slice`, as they arrive over time.

    With ``repeats`` every seventh event comes again two slices on (after the last slice the
    first follows, so some come before what they replace), as another object landed an
    hour later, with one more dollar.
    """
    number = F.col("event_id") % SLICES
    first = with_bronze(events_df.withColumn("slice", number), "slice")
    if not repeats:
        return first
    again = events_df.filter("event_id % 7 = 0").withColumns({"slice": (number + 2) % SLICES, "value": F.col("value") + 1})
    amended = with_bronze(again, "slice").withColumns(
        {
            "source_key": F.concat("source_key", F.lit(".2")),
            "landed_at": F.col("landed_at") + F.expr("INTERVAL 1 HOUR"),
        }
    )
    return first.unionByName(amended)


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze of all events.

    A test table of one small file is read by one task. Only where the session sets
    tidemark.feed.partitions, as the bench does, its rows are dealt out first.
    """
    return with_bronze(dealt(events(spark, sf_dir)))


def dealt(rows: DataFrame) -> DataFrame:
    parts = rows.sparkSession.conf.get("tidemark.feed.partitions", None)
    return rows.repartition(int(parts)) if parts else rows


def cleansed(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = (), gate: bool = False) -> DataFrame:
    return C.cleanse(bronze(spark, sf_dir), WATERMARK, LOOKBACK_DAYS, keep=keep, gate=gate)


def silver(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return C.accepted(cleansed(spark, sf_dir, keep))


def stored_zones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Silver and Gold as stored: the texts are parsed once, and what reads the zones can prune by type and day."""
    root = scratch_path(spark, "zones")
    rows = silver(spark, sf_dir, ("landed_at",)).select(*SILVER_SCHEMA.names)
    sinks.write_partitions(rows, f"{root}/silver", ("event_type", "dt"))
    kept = sinks.read_silver(spark, f"{root}/silver")
    sinks.write_gold(daily_metrics(kept, ordered=False), f"{root}/gold")
    gold = sinks.read_gold(spark, f"{root}/gold").withColumnRenamed("metric", "event_type").drop("metric_day")
    return kept, gold
