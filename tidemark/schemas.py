"""Types, enumerations and zone contracts.

Everything here is plain data: the operators read it, none of it runs.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Event classes, rejection reasons, gate checks.
EVENT_TYPES = ("page_view", "add_to_cart", "purchase", "refund")

EVENT_TYPE_LABELS = {
    "page_view": "Page view",
    "add_to_cart": "Add to cart",
    "purchase": "Purchase",
    "refund": "Refund",
}

QUALITY_CHECKS = (
    "event_id_present",
    "known_event_type",
    "required_dimensions",
    "quantity_and_amount_sane",
    "schema_valid",
)

DEFAULT_COUNTRY = "US"
DEFAULT_LOOKBACK_DAYS = 2
SUCCESS_STATUSES = ("succeeded",)
# Statuses, zones and steps of a run.
RUN_STATUSES = ("pending", "running", "succeeded", "failed", "quality_failed")
RUN_ZONES = ("bronze", "silver", "gold")
RUN_STEPS = ("ingest", "silver", "quality", "gold", "pipeline", "reprocess")

# A type may change to one of these without breaking readers.
TYPE_WIDENS_TO = {
    "integer": ("number",),
    "date": ("datetime", "string"),
    "datetime": ("string",),
    "boolean": ("string",),
}


# The fields of each zone contract.
def _field(name, type_, required=False, enum=None):
    return {"name": name, "type": type_, "required": required, "enum": enum}


BRONZE_CONTRACT = {
    "name": "commerce_event_raw",
    "hive": ("dt",),
    "fields": (
        _field("event_id", "string", True),
        _field("event_ts", "datetime", True),
        _field("event_type", "string", True, EVENT_TYPES),
        _field("user_id", "string", True),
        _field("sku", "string", True),
        _field("quantity", "integer", True),
        _field("amount_usd", "number", True),
        _field("country", "string", False),
    ),
}

SILVER_CONTRACT = {
    "name": "commerce_event_conformed",
    "hive": ("event_type", "dt"),
    "fields": (
        _field("event_id", "string", True),
        _field("event_ts", "datetime", True),
        _field("event_type", "string", True, EVENT_TYPES),
        _field("user_id", "string", True),
        _field("sku", "string", True),
        _field("quantity", "integer", True),
        _field("amount_usd", "number", True),
        _field("country", "string", True),
        _field("_late", "boolean", True),
    ),
}

GOLD_CONTRACT = {
    "name": "daily_event_metrics",
    "hive": ("metric", "dt"),
    "fields": (
        _field("dt", "date", True),
        _field("event_type", "string", True, EVENT_TYPES),
        _field("events", "integer", True),
        _field("amount_usd", "number", True),
    ),
}

RUN_CONTRACT = {
    "name": "pipeline_run",
    "hive": (),
    "fields": (
        _field("run_id", "string", True),
        _field("status", "string", False, RUN_STATUSES),
        _field("started_at", "datetime"),
        _field("finished_at", "datetime"),
        _field("zone", "string", False, RUN_ZONES),
        _field("step", "string", False, RUN_STEPS),
        _field("parent_run_id", "string"),
        _field("error", "string"),
        _field("objects", "json-string"),
        _field("object_count", "number"),
        _field("quality", "json-string"),
        _field("metrics", "json-string"),
    ),
}

CONTRACTS = {
    "bronze": BRONZE_CONTRACT,
    "silver": SILVER_CONTRACT,
    "gold": GOLD_CONTRACT,
    "pipeline_run": RUN_CONTRACT,
}

BRONZE_SCHEMA = "raw STRING, source_key STRING, landed_at TIMESTAMP"

# Columns of a conformed event, in storage order.
EVENT_COLUMNS = (
    "event_id",
    "event_ts",
    "event_type",
    "user_id",
    "sku",
    "quantity",
    "amount_usd",
    "country",
)

SILVER_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("amount_usd", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("_late", T.BooleanType()),
        T.StructField("landed_at", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("dt", T.StringType()),
    ]
)

GOLD_SCHEMA = T.StructType(
    [
        T.StructField("metric_day", T.StringType()),
        T.StructField("events", T.LongType()),
        T.StructField("amount_usd", T.DoubleType()),
        T.StructField("metric", T.StringType()),
        T.StructField("dt", T.StringType()),
    ]
)

QUALITY_RESULT = T.StructType(
    [
        T.StructField("check_name", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("rows_scanned", T.LongType()),
        T.StructField("rows_failed", T.LongType()),
        T.StructField("detail", T.StringType()),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("zone", T.StringType()),
        T.StructField("step", T.StringType()),
        T.StructField("parent_run_id", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("object_count", T.LongType()),
        T.StructField("objects", T.StringType()),
        T.StructField("quality", T.StringType()),
        T.StructField("metrics", T.StringType()),
    ]
)

# Emitted metric names and their units.
METRIC_UNITS = {
    "RecordsProcessed": "Count",
    "QualityFailures": "Count",
    "QualityFailRatio": "None",
    "LateEvents": "Count",
    "PipelineLagSeconds": "Seconds",
    "EstimatedBytes": "Bytes",
    "ObjectsWritten": "Count",
    "RunDurationMilliseconds": "Milliseconds",
}
BYTES_PER_RECORD = 2048
BYTES_PER_GOLD_OBJECT = 8192

# Fixed values of the lineage graph: node -> (zone, kind), edges (from, to, relation), families.
LINEAGE_NODES = {
    "bronze": ("bronze", "raw_events"),
    "silver": ("silver", "cleansed_events"),
    "silver_quarantine": ("silver", "quality_quarantine"),
    "quality": ("silver", "quality_report"),
    "gold": ("gold", "daily_metrics"),
    "gold_quarantine": ("gold", "rejected_metrics"),
    "runs": ("control", "pipeline_run"),
}
LINEAGE_EDGES = (
    ("bronze", "silver", "cleanse"),
    ("bronze", "silver_quarantine", "reject"),
    ("silver", "quality", "gate"),
    ("quality", "silver_quarantine", "quarantine"),
    ("quality", "gold", "aggregate"),
    ("quality", "gold_quarantine", "reject"),
    ("silver", "gold_quarantine", "unreadable"),
    ("bronze", "runs", "run_metadata"),
    ("silver", "runs", "run_metadata"),
    ("silver_quarantine", "runs", "run_metadata"),
    ("quality", "runs", "run_metadata"),
    ("gold", "runs", "run_metadata"),
    ("gold_quarantine", "runs", "run_metadata"),
)
QUARANTINE_NODES = ("silver_quarantine", "gold_quarantine")
RELATION_FAMILIES = {
    "cleanse": ("cleanse", "aggregate", "gate"),
    "reject": ("reject", "unreadable"),
    "quarantine": ("quarantine",),
}
CLEANSE_FLOOR = 0.60
BRONZE_CLEANSE_FLOOR = 0.80
QUALITY_AGGREGATE_FLOOR = 0.15
QUALITY_REJECT_CEILING = 0.50

FRESHNESS_BUDGET_HOURS = 24.0

# Maintenance policy per dataset: zone path, partition columns, days kept, most
# objects a partition may hold before it is compacted.
MAINTENANCE_POLICY = {
    "bronze.raw_events": ("bronze/events", ("dt",), 30, 8),
    "silver.cleaned_events": ("silver/events", ("event_type", "dt"), 60, 8),
    "silver.quarantine": ("silver/quarantine", ("reason",), 14, 8),
    "gold.daily_metrics": ("gold/metrics", ("metric", "dt"), 90, 2),
    "gold.quarantine": ("gold/quarantine", ("reason", "metric", "dt"), 30, 2),
}
