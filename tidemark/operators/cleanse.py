"""Bronze to Silver: conform each record, name its first fault, flag lateness."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import payload as P
from tidemark.functions.once import evaluate_once
from tidemark.schemas import (
    DEFAULT_COUNTRY,
    DEFAULT_LOOKBACK_DAYS,
    EVENT_COLUMNS,
    EVENT_TYPES,
)


def inspect(
    bronze: DataFrame, raw: str = "raw", keep: tuple[str, ...] | None = None, gate: bool = True
) -> DataFrame:
    """Typed fields and verdict of each raw record, parsed once per row.

    Unknown fields are dropped. ``keep`` names the input columns to carry; all of
    them by default, but for those the record itself gives. The result has one row per input row, with `reason` (first
    failing rule, NULL when accepted) and, with ``gate``, `checks` (every failed
    gate check).
    """
    derived = {*EVENT_COLUMNS, "dt", "reason", "checks"}
    carried = [c for c in (bronze.columns if keep is None else keep) if c not in derived]
    fields = {name: P.Field(name, name not in ("quantity", "amount_usd")) for name in EVENT_COLUMNS}
    when, quantity, amount, country = (fields[n] for n in ("event_ts", "quantity", "amount_usd", "country"))
    texts = [fields[n] for n in ("event_id", "event_type", "user_id", "sku")]
    known = ", ".join(P.sql_text(t) for t in EVENT_TYPES)

    frame = P.with_document(bronze.select(*{*carried, raw}), raw, "_record", tuple(fields))
    frame = frame.selectExpr(
        *carried, f"{P.is_empty_object(raw)} AS _empty", *[f.value_column("_record") for f in fields.values()]
    )
    details = [column for f in fields.values() for column in f.detail_columns()]
    frame = frame.selectExpr(*carried, "_empty", *details)
    frame = frame.selectExpr(
        "*", f"{when.is_iso} AS _iso", f"{quantity.integer} AS quantity", f"{amount.double} AS amount_usd"
    )
    frame = frame.selectExpr("*", f"{when.instant('_iso')} AS event_ts")
    frame = frame.selectExpr(
        *carried,
        "_empty",
        "event_ts",
        "quantity",
        "amount_usd",
        *[f"{f.as_text} AS {f.name}" for f in texts],
        f"CASE WHEN {country.kind} IS NULL THEN {P.sql_text(DEFAULT_COUNTRY)} ELSE {country.as_text} END AS country",
        f"{when.local_day('_iso', 'event_ts')} AS dt",
        f"NOT {fields['event_id'].is_blank} AS _has_id",
        *([f"NOT ({fields['user_id'].is_blank}) AND NOT ({fields['sku'].is_blank}) AS _has_dims"] if gate else []),
        f"{quantity.kind} IS NOT NULL AND {amount.kind} IS NOT NULL "
        f"AND coalesce({quantity.is_whole('quantity')}, false) AS _measures_typed",
        f"coalesce(trim(BOTH {P.sql_text(P.WHITESPACE)} FROM {fields['event_type'].as_text}) IN ({known}), false) AS _known",
    )
    frame = frame.selectExpr(
        "*",
        "quantity IS NOT NULL AND amount_usd IS NOT NULL AS _numeric",
        """event_id IS NOT NULL AND event_ts IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL
           AND sku IS NOT NULL AND country IS NOT NULL AND _measures_typed AND coalesce(quantity >= 0, false)
           AND coalesce(amount_usd >= 0 AND NOT isnan(amount_usd), false) AS _schema_ok""",
    )
    verdict = {
        "reason": """CASE WHEN _empty THEN 'empty_record'
             WHEN NOT _has_id THEN 'missing_event_id'
             WHEN NOT _known THEN 'unknown_event_type'
             WHEN NOT _numeric THEN 'non_numeric_measures'
             WHEN quantity <= 0 THEN 'non_positive_quantity'
             WHEN amount_usd < 0 THEN 'negative_amount'
             WHEN NOT _schema_ok THEN 'schema_invalid' END"""
    }
    if gate:
        verdict["checks"] = failed_names_sql(
            {
                "event_id_present": "NOT _has_id",
                "known_event_type": "NOT _known",
                "required_dimensions": "NOT _has_dims",
                "quantity_and_amount_sane": "NOT _numeric OR quantity <= 0 OR amount_usd < 0",
                "schema_valid": "NOT _schema_ok",
            }
        )
    frame = frame.selectExpr("*", *[f"{rule} AS {name}" for name, rule in verdict.items()])
    return evaluate_once(frame, *carried, *EVENT_COLUMNS, "dt", *verdict)


def failed_names_sql(faults: dict[str, str]) -> str:
    """SQL of an array with the names of the faults that hold, in order."""
    flags = ", ".join(f"CASE WHEN {fault} THEN {P.sql_text(name)} END" for name, fault in faults.items())
    return f"filter(array({flags}), name -> name IS NOT NULL)"


def failed_names(faults: dict[str, Column]) -> Column:
    """Names of the faults that hold, in the given order."""
    flags = [F.when(F.coalesce(fault, F.lit(False)), name) for name, fault in faults.items()]
    return F.filter(F.array(*flags), lambda name: name.isNotNull())


def late_flag(
    event_ts: Column,
    watermark: datetime | str | Column,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
) -> Column:
    """Strictly older than watermark - lookback. A tag only: late rows stay."""
    return event_ts < _instant(watermark) - F.expr(f"INTERVAL '{int(lookback_days)}' DAY")


def _instant(value: datetime | str | Column) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        value = aware.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f+00:00")
    return F.to_timestamp(F.lit(value))


def cleanse(
    bronze: DataFrame,
    watermark: datetime | str | None = None,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    raw: str = "raw",
    keep: tuple[str, ...] | None = None,
    gate: bool = False,
) -> DataFrame:
    """Every Bronze row with its typed fields, `reason` and `_late`.

    The default watermark is the time of the call. `accepted` and `quarantined`
    split the result.
    """
    mark = watermark or datetime.now(tz=timezone.utc)
    late = late_flag(F.col("event_ts"), mark, lookback_days)
    return inspect(bronze, raw, keep, gate).withColumn("_late", F.when(F.col("reason").isNull(), late))


def accepted(cleansed: DataFrame) -> DataFrame:
    """Silver rows: on time and late together."""
    return cleansed.filter(F.col("reason").isNull()).drop("reason", "checks", "raw")


def quarantined(cleansed: DataFrame) -> DataFrame:
    """Rejected rows with their reason; every row is kept, as raw text."""
    return cleansed.filter(F.col("reason").isNotNull())
