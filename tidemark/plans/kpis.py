"""Business measures over Silver and Gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _of(event_type: str, value: Column | None = None) -> Column:
    return F.when(F.col("event_type") == event_type, F.lit(1) if value is None else value)


def kpi_summary(silver: DataFrame) -> DataFrame:
    """One row of the headline measures, in one pass over Silver."""
    amount = F.col("amount_usd")
    gmv = F.coalesce(F.sum(_of("purchase", amount)), F.lit(0.0))
    refunds = F.coalesce(F.sum(_of("refund", amount)), F.lit(0.0))
    purchases = F.count(_of("purchase"))
    events = F.count(F.lit(1))
    late = F.count_if("_late")
    return silver.agg(
        events.alias("event_volume"),
        F.round(gmv, 2).alias("gmv_usd"),
        F.round(refunds, 2).alias("refund_usd"),
        F.round(gmv - refunds, 2).alias("net_revenue_usd"),
        F.count(_of("page_view")).alias("page_views"),
        F.count(_of("add_to_cart")).alias("add_to_carts"),
        purchases.alias("purchases"),
        F.round(F.when(events == 0, F.lit(0.0)).otherwise(late / events), 4).alias("late_rate"),
        F.round(F.when(purchases > 0, gmv / purchases), 4).alias("average_order_value"),
        F.coalesce(F.sum(_of("purchase", F.col("quantity"))), F.lit(0)).alias("units_sold"),
    )


def daily_kpis(gold: DataFrame) -> DataFrame:
    """Per-day revenue and funnel from Gold alone."""
    amount, events = F.col("amount_usd"), F.col("events")
    zero, none = F.lit(0.0), F.lit(0)
    by_day = gold.groupBy("dt").agg(
        F.sum("events").alias("event_volume"),
        F.coalesce(F.sum(_of("purchase", amount)), zero).alias("gmv_usd"),
        F.coalesce(F.sum(_of("refund", amount)), zero).alias("refund_usd"),
        F.coalesce(F.sum(_of("page_view", events)), none).alias("page_views"),
        F.coalesce(F.sum(_of("add_to_cart", events)), none).alias("add_to_carts"),
        F.coalesce(F.sum(_of("purchase", events)), none).alias("purchases"),
    )
    return by_day.withColumn("net_revenue_usd", F.round(F.col("gmv_usd") - F.col("refund_usd"), 2))


def sku_ranking(silver: DataFrame, event_type: str = "add_to_cart") -> DataFrame:
    """Events per SKU and day for one type."""
    return silver.filter(F.col("event_type") == event_type).groupBy("dt", "sku").agg(F.count(F.lit(1)).alias("events"))


def top_sku(silver: DataFrame, event_type: str = "add_to_cart") -> DataFrame:
    """The leading SKU of each day; ties go to the smaller name.

    `min_by` over the counted rows, so no day is gathered and sorted.
    """
    counts = sku_ranking(silver, event_type)
    rank = F.struct((-F.col("events")).alias("order"), F.col("sku"))
    return counts.groupBy("dt").agg(F.min_by("sku", rank).alias("sku"), F.max("events").alias("events"))


def zone_counts(cleansed: DataFrame) -> DataFrame:
    """Bronze, Silver and quarantine volume by reason, to see what the gate hides."""
    label = F.coalesce("reason", F.lit("accepted"))
    rows = F.array(
        F.struct(F.lit("bronze").alias("zone"), F.lit("all").alias("reason")),
        F.struct(
            F.when(F.col("reason").isNull(), "silver").otherwise("silver_quarantine").alias("zone"), label.alias("reason")
        ),
    )
    return cleansed.select(F.inline(rows)).groupBy("zone", "reason").agg(F.count(F.lit(1)).alias("records"))


def late_effect(silver: DataFrame, gold: DataFrame, event_type: str = "refund") -> DataFrame:
    """Late rows of one type per day next to the Gold row they belong to."""
    late = (
        silver.filter(F.col("_late") & (F.col("event_type") == event_type))
        .groupBy("dt")
        .agg(F.count(F.lit(1)).alias("late_events"), F.round(F.sum("amount_usd"), 2).alias("late_amount_usd"))
    )
    day = gold.filter(F.col("event_type") == event_type).select("dt", "events", "amount_usd")
    return late.join(day, "dt")


def events_with_daily_metric(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Silver events next to the Gold row of their type and day.

    Pass a stored or materialized Gold: its size is then known, and Spark
    broadcasts it only below its limit, else it sorts and merges.
    """
    metric = gold.select("event_type", "dt", F.col("events").alias("day_events"), F.col("amount_usd").alias("day_amount_usd"))
    return silver.join(metric, ["event_type", "dt"], "inner")


def busy_days(silver: DataFrame, gold: DataFrame, deviations: float = 2.0) -> DataFrame:
    """Silver events of the types and days with far more events than the average one.

    With stored zones the chosen Gold rows prune Silver's partitions while the query runs.
    """
    usual = gold.agg((F.avg("events") + deviations * F.stddev_pop("events")).alias("limit"))
    return events_with_daily_metric(silver, gold.filter(F.col("events") > usual.scalar()))
