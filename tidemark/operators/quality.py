"""Quality gate: named checks, tallies, decision, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.payload import strip
from tidemark.operators.cleanse import failed_names
from tidemark.schemas import EVENT_TYPES, QUALITY_CHECKS

ON_FAIL = ("fail", "quarantine")


def _blank(text: str) -> Column:
    return F.coalesce(strip(F.col(text)) == "", F.lit(True))


def with_checks(silver: DataFrame) -> DataFrame:
    """Add `checks`, the gate checks a typed event row fails."""
    quantity, amount = F.col("quantity"), F.col("amount_usd")
    missing = F.lit(False)
    for name in ("event_id", "event_ts", "event_type", "user_id", "sku", "country"):
        missing = missing | F.col(name).isNull()
    faults = {
        "event_id_present": _blank("event_id"),
        "known_event_type": ~F.coalesce(strip(F.col("event_type")).isin(*EVENT_TYPES), F.lit(False)),
        "required_dimensions": _blank("user_id") | _blank("sku"),
        "quantity_and_amount_sane": quantity.isNull() | amount.isNull() | (quantity <= 0) | (amount < 0),
        "schema_valid": missing
        | quantity.isNull()
        | amount.isNull()
        | (quantity < 0)
        | (amount < 0)
        | F.isnan(amount),
    }
    return silver.withColumn("checks", failed_names(faults))


def tally(checked: DataFrame) -> DataFrame:
    """One row: rows scanned, rows failing any check, rows failing each check."""
    return checked.agg(
        F.count(F.lit(1)).alias("rows_scanned"),
        F.count_if(F.size("checks") > 0).alias("rows_failed"),
        *[F.count_if(F.array_contains("checks", name)).alias(name) for name in QUALITY_CHECKS],
    )


def check_results(tallied: DataFrame) -> DataFrame:
    """One row per check, from the tally row."""
    results = F.array(
        *[
            F.struct(
                F.lit(name).alias("check_name"),
                (F.col(name) == 0).alias("passed"),
                F.col("rows_scanned"),
                F.col(name).alias("rows_failed"),
                F.lit("").alias("detail"),
            )
            for name in QUALITY_CHECKS
        ]
    )
    return tallied.select(F.inline(results))


def decide(tallied: DataFrame, on_fail: str = "fail", max_fail_ratio: float = 0.0) -> DataFrame:
    """Gate decision of a tally row.

    Breached when the failed share is above the allowed one and some row failed;
    an empty batch passes.
    """
    if on_fail not in ON_FAIL:
        raise ValueError(f"on_fail must be one of {ON_FAIL}")
    ratio = F.when(F.col("rows_scanned") == 0, F.lit(0.0)).otherwise(
        F.col("rows_failed") / F.col("rows_scanned")
    )
    breached = (ratio > F.lit(max_fail_ratio)) & (F.col("rows_failed") > 0)
    return tallied.select(
        (~breached).alias("passed"),
        F.when(breached, F.lit(on_fail)).otherwise(F.lit("pass")).alias("action"),
        "rows_scanned",
        "rows_failed",
        F.round(ratio, 4).alias("fail_ratio"),
        F.concat_ws(", ", *[F.when(F.col(n) > 0, F.lit(n)) for n in QUALITY_CHECKS]).alias("failed_checks"),
        *QUALITY_CHECKS,
    )


def report(tallied: DataFrame, run_id: str | Column, on_fail: str = "fail", max_fail_ratio: float = 0.0) -> DataFrame:
    """One-row gate report with the check results nested."""
    rid = run_id if isinstance(run_id, Column) else F.lit(run_id)
    checks = F.array(
        *[
            F.struct(
                F.lit(name).alias("check_name"),
                (F.col(name) == 0).alias("passed"),
                F.col("rows_scanned"),
                F.col(name).alias("rows_failed"),
                F.lit("").alias("detail"),
            )
            for name in QUALITY_CHECKS
        ]
    )
    return decide(tallied, on_fail, max_fail_ratio).select(
        rid.alias("run_id"),
        "passed",
        "action",
        "rows_scanned",
        "rows_failed",
        "fail_ratio",
        checks.alias("checks"),
    )


def failing(checked: DataFrame) -> DataFrame:
    """Rows that fail the gate, with all failed checks joined by '+'."""
    return checked.filter(F.size("checks") > 0).withColumn("reason", F.array_join("checks", "+"))


def passing(checked: DataFrame) -> DataFrame:
    """The clean subset, for a quarantine-mode run that goes on to Gold."""
    return checked.filter(F.size("checks") == 0).drop("checks")


def summary(checked: DataFrame, on_fail: str = "quarantine", max_fail_ratio: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Gate decision of a batch, and the ids of its failing rows with reasons."""
    reasons = checked.filter(F.size("checks") > 0).select(
        F.coalesce("event_id", F.lit("")).alias("event_id"), F.col("checks").alias("reasons")
    )
    return decide(tally(checked), on_fail, max_fail_ratio), reasons
