"""Freshness, zone counts, lineage weights, path ratios and their alert."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.days import age_hours, parse_instant
from tidemark.schemas import (
    BRONZE_CLEANSE_FLOOR,
    CLEANSE_FLOOR,
    FRESHNESS_BUDGET_HOURS,
    LINEAGE_EDGES,
    LINEAGE_NODES,
    QUALITY_AGGREGATE_FLOOR,
    QUALITY_REJECT_CEILING,
    QUARANTINE_NODES,
    RELATION_FAMILIES,
    RUN_SCHEMA,
    SUCCESS_STATUSES,
)
from tidemark.sources.objects import inventory
from tidemark.sources.storage import exists


def freshness(
    written: DataFrame,
    as_of: datetime | str,
    max_age_hours: float = FRESHNESS_BUDGET_HOURS,
    last_written: str = "last_written",
) -> DataFrame:
    """Age of each dataset against its budget; an age equal to it is ok."""
    stamp = as_of if isinstance(as_of, datetime) else parse_instant(as_of)
    now = F.to_timestamp(F.lit(stamp.isoformat()))
    aged = written.withColumn("age_hours", age_hours(now, F.col(last_written)))
    ok = F.col("age_hours") <= F.lit(float(max_age_hours))
    return aged.withColumn("max_age_hours", F.lit(float(max_age_hours))).withColumns(
        {"status": F.when(ok, "ok").otherwise("breached"), "ok": ok}
    )


def last_gold_write(objects: DataFrame, runs: DataFrame) -> DataFrame:
    """One row (last_written, source): newest Gold object, else the newest finish of a succeeded run, else none."""
    gold = objects.agg(F.max("modificationTime").alias("at")).select("at", F.lit(1).alias("prefer"), F.lit("gold").alias("source"))
    finished = runs.filter(F.col("status").isin(*SUCCESS_STATUSES, "success", "completed"))
    run = finished.agg(F.max(F.coalesce("finished_at", "started_at")).alias("at"))
    known = gold.unionByName(run.select("at", F.lit(2).alias("prefer"), F.lit("runs").alias("source"))).filter(F.col("at").isNotNull())
    return known.agg(
        F.min_by("at", "prefer").alias("last_written"), F.coalesce(F.min_by("source", "prefer"), F.lit("none")).alias("source")
    )


def gold_freshness(
    spark: SparkSession, root: str, as_of: datetime | str, max_age_hours: float = FRESHNESS_BUDGET_HOURS
) -> DataFrame:
    """Freshness of the stored Gold zone by when its files were committed, with the run log behind it.

    Only listings and the run log are read. Where neither knows a write the age is null and
    the status unknown.
    """
    gold, runs = f"{root}/gold/metrics", f"{root}/runs"
    nothing = "CAST(NULL AS TIMESTAMP) AS modificationTime"
    listed = inventory(spark, gold, "*.parquet") if exists(spark, gold) else spark.range(0).selectExpr(nothing)
    log = spark.read.schema(RUN_SCHEMA).parquet(runs) if exists(spark, runs) else spark.range(0).selectExpr(
        "'' AS status", "CAST(NULL AS TIMESTAMP) AS finished_at", "CAST(NULL AS TIMESTAMP) AS started_at"
    )
    checked = freshness(last_gold_write(listed, log), as_of, max_age_hours)
    return checked.withColumn("status", F.when(F.col("source") == "none", "unknown").otherwise(F.col("status")))


def nodes_from_counts(counts: DataFrame) -> DataFrame:
    """Lineage nodes (id, zone, kind, objects) from one row of counts.

    ``counts`` has a column per node id; a NULL count stays NULL.
    """
    rows = [
        F.struct(
            F.lit(node).alias("id"),
            F.lit(zone).alias("zone"),
            F.lit(kind).alias("kind"),
            (F.col(node) if node in counts.columns else F.lit(None)).cast("bigint").alias("objects"),
        )
        for node, (zone, kind) in LINEAGE_NODES.items()
    ]
    return counts.select(F.inline(F.array(*rows)))


def edge_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LINEAGE_EDGES), "src STRING, dst STRING, relation STRING")


def edge_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge with its destination's object count; unknown ends give NULL.

    The graph has seven nodes by definition, so the broadcast side is fixed.
    """
    ends = F.broadcast(nodes.select(F.col("id").alias("dst"), F.col("objects").alias("weight")))
    return edges.join(ends, "dst", "left").select("src", "dst", "relation", "weight")


def quarantine_subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges touching the two quarantine leaves, one labelled row each."""
    inside = F.col("id").isin(*QUARANTINE_NODES)
    node_rows = nodes.filter(inside).select(
        F.lit("node").alias("part"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"),
        F.col("kind").alias("relation"), F.col("objects").alias("weight"),
    )
    incoming = edges.filter(F.col("dst").isin(*QUARANTINE_NODES)).select(F.lit("incoming").alias("part"), *edges.columns)
    outgoing = edges.filter(F.col("src").isin(*QUARANTINE_NODES)).select(F.lit("outgoing").alias("part"), *edges.columns)
    return node_rows.unionByName(incoming).unionByName(outgoing)


def subgraph_totals(subgraph: DataFrame) -> DataFrame:
    def total(part: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("part") == part, F.col("weight"))), F.lit(0)).cast("bigint")

    return subgraph.agg(
        total("node").alias("objects"),
        total("incoming").alias("incoming_weight"),
        total("outgoing").alias("outgoing_weight"),
    )


def _family(relation: Column) -> Column:
    label = F.lit(None).cast("string")
    for family, relations in RELATION_FAMILIES.items():
        label = F.when(relation.isin(*relations), F.lit(family)).otherwise(label)
    return label


def path_ratios(edges: DataFrame) -> DataFrame:
    """Weight and share of each path, for three cuts of the graph.

    Cuts: `family` (cleanse, reject, quarantine over all edges but run metadata),
    `bronze_split` and `quality_split`. A cut without weight has share 0.
    """
    weight = F.coalesce(F.col("weight"), F.lit(0)).cast("bigint")
    relation = F.col("relation")
    bronze = (F.col("src") == "bronze") & relation.isin("cleanse", "reject")
    quality = (F.col("src") == "quality") & relation.isin("aggregate", "reject", "quarantine")
    cuts = F.array(
        F.struct(F.lit("family").alias("cut"), _family(relation).alias("path")),
        F.struct(F.lit("bronze_split").alias("cut"), F.when(bronze, relation).alias("path")),
        F.struct(F.lit("quality_split").alias("cut"), F.when(quality, relation).alias("path")),
    )
    spread = edges.select(weight.alias("weight"), F.inline(cuts)).filter(F.col("path").isNotNull())
    by_path = spread.groupBy("cut", "path").agg(F.sum("weight").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("cut"))
    share = F.when(F.col("total") <= 0, F.lit(0.0)).otherwise(F.round(F.col("weight") / F.col("total"), 4))
    return by_path.withColumn("total", total).select("cut", "path", "weight", "total", share.alias("ratio"))


def ratio_alert(
    ratios: DataFrame,
    cleanse_floor: float = CLEANSE_FLOOR,
    bronze_cleanse_floor: float = BRONZE_CLEANSE_FLOOR,
    quality_aggregate_floor: float = QUALITY_AGGREGATE_FLOOR,
    quality_reject_ceiling: float = QUALITY_REJECT_CEILING,
) -> DataFrame:
    """One row: the shares under watch, a flag per cut, and the overall status."""

    def share(cut: str, path: str) -> Column:
        here = (F.col("cut") == cut) & (F.col("path") == path)
        return F.coalesce(F.max(F.when(here, F.col("ratio"))), F.lit(0.0))

    def volume(cut: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("cut") == cut, F.col("total"))), F.lit(0))

    row = ratios.agg(
        share("family", "cleanse").alias("cleanse_share"),
        share("bronze_split", "cleanse").alias("bronze_cleanse_share"),
        share("quality_split", "aggregate").alias("quality_aggregate_share"),
        share("quality_split", "reject").alias("quality_reject_share"),
        volume("family").alias("_family"),
        volume("bronze_split").alias("_bronze"),
        volume("quality_split").alias("_quality"),
    )
    flags = row.select(
        "cleanse_share",
        "bronze_cleanse_share",
        "quality_aggregate_share",
        "quality_reject_share",
        ((F.col("_family") <= 0) | (F.col("cleanse_share") >= cleanse_floor)).alias("family_ok"),
        ((F.col("_bronze") <= 0) | (F.col("bronze_cleanse_share") >= bronze_cleanse_floor)).alias("bronze_ok"),
        (
            (F.col("_quality") <= 0)
            | (
                (F.col("quality_aggregate_share") >= quality_aggregate_floor)
                & (F.col("quality_reject_share") <= quality_reject_ceiling)
            )
        ).alias("quality_ok"),
    )
    ok = F.col("family_ok") & F.col("bronze_ok") & F.col("quality_ok")
    return flags.withColumns({"ok": ok, "status": F.when(ok, "ok").otherwise("breached")})
