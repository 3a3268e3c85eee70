"""Flattening stored envelopes of events and quarantine rows.

A stored object holds one record, a list of records, or an envelope with an
`events`, `rejected` or raw list. Each becomes its records, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import payload as P
from tidemark.functions.once import evaluate_once

EVENT_LISTS = ("events", "_raw")
QUARANTINE_LISTS = ("events", "rejected")


def _list_of(value: Column) -> Column:
    return F.when(P.kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def flatten(objects: DataFrame, keys: tuple[str, ...], lists: tuple[str, ...], raw: str = "raw") -> DataFrame:
    """Records of stored objects with their partition keys, as VARIANT `record`."""
    parsed = evaluate_once(P.with_document(objects.select(*keys, raw), raw, "_doc"), *keys, "_doc")
    doc = F.col("_doc")
    single = F.when(P.kind(doc).startswith("OBJECT"), F.array(doc))
    nested = [_list_of(P.field(doc, name)) for name in lists]
    spread = parsed.select(*keys, F.explode(F.coalesce(_list_of(doc), *nested, single)).alias("record"))
    return spread.filter(P.kind(F.col("record")).startswith("OBJECT"))


def _merged(objects: DataFrame, keys: tuple[str, ...], lists: tuple[str, ...], raw: str) -> DataFrame:
    parsed = evaluate_once(P.with_document(objects.select(*keys, raw), raw, "_doc"), *keys, "_doc")
    doc = F.col("_doc")
    items = F.coalesce(
        _list_of(doc),
        *[_list_of(P.field(doc, name)) for name in lists],
        F.when(P.kind(doc).startswith("OBJECT"), F.array(doc)),
    )
    records = F.size(F.filter(items, lambda item: P.kind(item).startswith("OBJECT")))
    counted = parsed.select(*keys, F.when(items.isNull(), 0).otherwise(records).alias("_records"))
    return counted.groupBy(*keys).agg(
        F.sum(F.col("_records").cast("bigint")).alias("record_count"),
        F.count(F.lit(1)).alias("compacted_from"),
    )


def merge_events(objects: DataFrame, keys: tuple[str, ...], raw: str = "raw") -> DataFrame:
    """Records and source objects per partition; unreadable sources count too."""
    return _merged(objects, keys, EVENT_LISTS, raw)


def merge_quarantine(objects: DataFrame, keys: tuple[str, ...], raw: str = "raw") -> DataFrame:
    return _merged(objects, keys, QUARANTINE_LISTS, raw)


def quarantine_labels(record: Column) -> dict[str, Column]:
    """Reason, metric and day of a Gold quarantine record, outer fields first."""

    def text(name: str) -> Column:
        return F.nullif(F.try_variant_get(record, f"$.{name}", "string"), F.lit(""))

    return {
        "reason": F.coalesce(text("reason"), F.lit("")),
        "metric": F.coalesce(text("metric"), text("event_type"), text("payload.event_type"), F.lit("unknown")),
        "dt": F.coalesce(text("dt"), text("payload.dt"), F.lit("")),
    }


def merge_gold_rejects(rejects: DataFrame) -> DataFrame:
    """Stored Gold rejects merged by reason, metric and day: records, and the runs they came from.

    A label that a row lacks is taken from its payload.
    """
    blank = F.lit("unknown")
    outer = F.struct("reason", *[F.nullif(F.col(c), blank).alias(c) for c in ("metric", "dt")])
    text = F.concat(
        F.expr("left(to_json(_outer), length(to_json(_outer)) - 1)"), F.lit(',"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}")
    )
    rows = rejects.withColumn("_outer", outer)
    labels = quarantine_labels(F.try_parse_json(text))
    named = rows.select("run_id", *[label.alias(name) for name, label in labels.items()])
    return named.groupBy("reason", "metric", "dt").agg(
        F.count(F.lit(1)).alias("record_count"), F.countDistinct("run_id").alias("compacted_from")
    )
