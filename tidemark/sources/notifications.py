"""Flattening storage notifications into object references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import payload as P
from tidemark.functions.once import evaluate_once


def _text(value: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(value, path, "string"), F.lit(""))


def _array(value: Column, path: str) -> Column:
    inner = F.try_variant_get(value, path, "variant")
    return F.when(P.kind(inner).startswith("ARRAY"), F.try_variant_get(inner, "$", "array<variant>"))


def _object(value: Column) -> Column:
    return F.when(P.kind(value).startswith("OBJECT"), value)


def _reference(bucket: Column, key: Column, name: Column, source: Column) -> Column:
    return F.struct(
        bucket.alias("bucket"), F.try_url_decode(key).alias("key"), name.alias("event_name"), source.alias("source")
    )


def _storage_record(record: Column, source: Column) -> Column:
    return _reference(
        _text(record, "$.s3.bucket.name"), _text(record, "$.s3.object.key"), _text(record, "$.eventName"), source
    )


def _bus_record(envelope: Column) -> Column:
    return _reference(
        _text(envelope, "$.detail.bucket.name"),
        _text(envelope, "$.detail.object.key"),
        F.try_variant_get(envelope, "$['detail-type']", "string"),
        F.lit("eventbridge"),
    )


def extract_refs(messages: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """Object references named by notification texts.

    Three shapes: native records, records wrapped in a queue message (its body a
    text or an object), and bus events with a detail. Whatever cannot be decoded
    names no object and is dropped.
    """
    parsed = evaluate_once(P.with_document(messages.select(*{*keep, raw}), raw, "_doc"), *keep, "_doc")
    top = parsed.select(*keep, _object(F.col("_doc")).alias("_doc")).filter(F.col("_doc").isNotNull())
    records = _array(F.col("_doc"), "$.Records")
    outer = top.select(
        *keep, F.explode(F.coalesce(records, F.array(F.col("_doc")))).alias("_item"), records.isNotNull().alias("_listed")
    )
    outer = outer.select(*keep, "_listed", _object(F.col("_item")).alias("_item"))
    origin = F.coalesce(F.try_variant_get("_item", "$.eventSource", "string"), F.lit(""))
    body = F.try_variant_get("_item", "$.body", "variant")
    queued = F.col("_listed") & (origin.endswith("sqs") | body.isNotNull())
    outer = outer.select(
        *keep,
        "_listed",
        queued.alias("_queued"),
        "_item",
        F.when(queued, body).alias("_inner"),
        F.when(queued & (P.kind(body) == "STRING"), F.try_variant_get(body, "$", "string")).alias("_text"),
    )
    outer = P.with_document(outer, "_text", "_parsed")
    unwrapped = F.when(F.col("_text").isNull(), F.col("_inner")).otherwise(F.col("_parsed"))
    outer = evaluate_once(outer.select(*keep, "_listed", "_queued", "_item", _object(unwrapped).alias("_body")))
    inner = _array(F.col("_body"), "$.Records")
    native = F.col("_listed") & ~F.col("_queued")
    refs = (
        F.when(native, F.array(_storage_record(F.col("_item"), F.lit("s3"))))
        .when(
            F.col("_queued"),
            F.coalesce(
                F.transform(inner, lambda r: _storage_record(r, F.lit("sqs"))), F.array(_bus_record(F.col("_body")))
            ),
        )
        .otherwise(F.array(_bus_record(F.col("_item"))))
    )
    flat = outer.select(*keep, F.inline(refs))
    return flat.filter(F.col("bucket").isNotNull() & F.col("key").isNotNull())


def undecodable(messages: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages that are no JSON object: the dead-letter candidates."""
    parsed = evaluate_once(P.with_document(messages.select(*{*keep, raw}), raw, "_doc"))
    return parsed.filter(~F.coalesce(P.kind(F.col("_doc")).startswith("OBJECT"), F.lit(False))).drop("_doc")
