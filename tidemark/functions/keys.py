"""Object keys in Hive layout: building, parsing, sanitising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.payload import strip

# Fixed pattern: the day segment of a key.
DAY_SEGMENT = r"(?:^|/)dt=(\d{4}-\d{2}-\d{2})(?:/|$)"


def day_of_key(key: Column) -> Column:
    """The dt= day of a key, NULL when it has none."""
    return F.nullif(F.regexp_extract(key, DAY_SEGMENT, 1), F.lit(""))


def hive_parts(key: Column) -> Column:
    """MAP of the name=value segments; segments with a blank side are dropped.

    The last segment wins when a name repeats.
    """
    pairs = F.transform(
        F.filter(F.split(F.btrim(key, F.lit("/")), "/"), lambda s: s.rlike(r"^[^=]+=.+$")),
        lambda s: F.struct(
            F.substring_index(s, "=", 1).alias("name"),
            s.substr(F.instr(s, "=") + F.lit(1), F.length(s)).alias("value"),
        ),
    )
    later = F.filter(
        pairs,
        lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["name"] == p["name"]),
    )
    return F.map_from_entries(later)


def hive_value(key: Column, name: str) -> Column:
    """Value of one name=value segment, NULL when absent or blank."""
    found = F.regexp_extract(key, rf"(?:^|/){name}=([^/]+)", 1)
    return F.nullif(found, F.lit(""))


def quarantine_event_id(key: Column) -> Column:
    """Leaf of a quarantine key without its .json suffix."""
    return F.nullif(F.regexp_extract(key, r"(?:^|/)([^/]*)\.json/*$", 1), F.lit(""))


def or_unknown(text: Column, fallback: str = "unknown") -> Column:
    return F.coalesce(F.nullif(strip(text), F.lit("")), F.lit(fallback))


def path_safe(text: Column) -> Column:
    return F.replace(text, F.lit("/"), F.lit("_"))


def bronze_key(dt: Column, event_id: Column) -> Column:
    return F.concat(F.lit("events/dt="), dt, F.lit("/"), event_id, F.lit(".json"))


def silver_key(event_type: Column, dt: Column, event_id: Column) -> Column:
    return F.concat(
        F.lit("events/event_type="), event_type, F.lit("/dt="), dt, F.lit("/"), event_id, F.lit(".json")
    )


def silver_quarantine_key(reason: Column, event_id: Column) -> Column:
    return F.concat(
        F.lit("quarantine/reason="), path_safe(reason), F.lit("/"), or_unknown(event_id), F.lit(".json")
    )


def gold_key(metric: Column, dt: Column) -> Column:
    return F.concat(F.lit("metrics/metric="), metric, F.lit("/dt="), dt, F.lit("/part-000.json"))


def gold_quarantine_key(reason: Column, metric: Column, dt: Column) -> Column:
    return F.concat(
        F.lit("quarantine/reason="),
        path_safe(or_unknown(reason, "rejected_metric")),
        F.lit("/metric="),
        path_safe(or_unknown(metric)),
        F.lit("/dt="),
        or_unknown(dt),
        F.lit("/part-000.json"),
    )


def metric_day(event_type: Column, dt: Column) -> Column:
    """Key of the serving copy of Gold."""
    return F.concat_ws("#", event_type, dt)
