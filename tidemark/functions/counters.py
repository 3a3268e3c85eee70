"""Run counters: the first usable number among keys, cost proxies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.payload import field, kind
from tidemark.schemas import BYTES_PER_GOLD_OBJECT, BYTES_PER_RECORD


def counter(metrics: Column, key: str) -> Column:
    """Integer reading of one counter, NULL when it has none.

    Flags are skipped, fractions truncated, a list counts its items.
    """
    value = field(metrics, key)
    label = kind(value)
    return F.when(
        label.startswith("ARRAY"),
        F.size(F.try_variant_get(value, "$", "array<variant>")).cast("bigint"),
    ).when(label != "BOOLEAN", F.try_variant_get(value, "$", "bigint"))


def first_counter(metrics: Column, *keys: str) -> Column:
    return F.coalesce(*[counter(metrics, key) for key in keys], F.lit(0).cast("bigint"))


def numeric_counter(metrics: Column, key: str) -> Column:
    """Double of a JSON number; NULL for anything else."""
    value = field(metrics, key)
    return F.when(~kind(value).isin("BOOLEAN", "STRING"), F.try_variant_get(value, "$", "double"))


def estimated_bytes(records: Column, gold_objects: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.greatest(records, zero) * BYTES_PER_RECORD + F.greatest(gold_objects, zero) * BYTES_PER_GOLD_OBJECT
