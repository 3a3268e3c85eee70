from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import digest
from tidemark.functions import keys as K
from tidemark.operators import identity as I
from tidemark.operators import partitions as PT


# Expected digests, computed once over parts that each follow their four-byte length.
HASH_B_E = "399f65fb200e745ce7cdca6e9a6f3b8b2bc07d13d0912c185e2e2387180b6bf4"
HASH_SILVER_A_B = "0dca296eaec01654ba45e3cd7023a68f44c6e7998131c0c58c6ea7cdfae403e5"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_content_hash_keeps_order(spark):
    got = one(spark, digest.content_hash(F.col("p")), p=["b", "é", ""])
    assert got == HASH_B_E
    assert got != one(spark, digest.content_hash(F.col("p")), p=["", "b", "é"])
    assert one(spark, digest.content_hash(F.col("p")), p=["ab", "c"]) != one(spark, digest.content_hash(F.col("p")), p=["a", "bc"])


def test_idempotency_key_sorts_and_drops_blanks(spark):
    key = one(spark, digest.idempotency_key("silver", F.col("p")), p=["b", "", "a"])
    assert key == "silver#" + HASH_SILVER_A_B
    assert one(spark, digest.run_id("silver", F.col("p")), p=["a", "b"]) == "silver-" + HASH_SILVER_A_B[:16]


def test_manifest_is_order_free_and_counts_copies(spark):
    def ident(keys):
        frame = spark.createDataFrame([(k,) for k in keys], "key STRING").repartition(3)
        return I.manifest_identity(frame, (), "key", "gold").first()["run_id"]

    assert ident(["a", "b", "c"]) == ident(["c", "a", "b"])
    assert len({ident(["a", "b"]), ident(["a", "b", "b"]), ident(["a", "c"]), ident(["ab"])}) == 4


def test_last_write_wins(spark):
    rows = spark.createDataFrame(
        [("purchase", "d1", "e1", 1, 5.0), ("purchase", "d1", "e1", 3, 7.0), ("purchase", "d1", "e1", 2, 6.0), ("refund", "d1", "e1", 1, 1.0)],
        "event_type STRING, dt STRING, event_id STRING, seen INT, amount_usd DOUBLE",
    )
    got = {tuple(r) for r in I.last_write(rows, I.SILVER_IDENTITY, ("seen",)).collect()}
    assert got == {("purchase", "d1", "e1", 3, 7.0), ("refund", "d1", "e1", 1, 1.0)}


def test_one_hot_key_collapses_before_the_shuffle(spark):
    rows = spark.range(20000).selectExpr("'t' AS event_type", "'d' AS dt", "'same' AS event_id", "id AS seen")
    latest = I.last_write(rows, I.SILVER_IDENTITY, ("seen",))
    assert latest.first()["seen"] == 19999
    assert "partial_max_by" in latest._jdf.queryExecution().executedPlan().toString()


def test_replays(spark):
    runs = spark.createDataFrame([("a", "succeeded"), ("b", "failed"), ("a", "running")], "run_id STRING, status STRING")
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id STRING")
    assert sorted(r[0] for r in I.pending_work(work, runs).collect()) == ["b", "c"]
    assert [r[0] for r in I.replays(work, runs).collect()] == ["a"]


@pytest.mark.parametrize(
    "key,day",
    [("events/dt=2026-01-02/a.json", "2026-01-02"), ("dt=2026-01-02", "2026-01-02"), ("xdt=2026-01-02/a", None),
     ("events/dt=2026-1-2/a", None), ("events/dt=2026-01-02x/a", None)],
)
def test_day_of_key(spark, key, day):
    assert one(spark, K.day_of_key(F.col("k")), k=key) == day


def test_hive_parts(spark):
    key = "/events/event_type=purchase/dt=2026-01-02/x=/=y/a=b=c/evt-1.json/"
    assert one(spark, K.hive_parts(F.col("k")), k=key) == {"event_type": "purchase", "dt": "2026-01-02", "a": "b=c"}
    assert one(spark, K.hive_parts(F.col("k")), k="a=1/a=2") == {"a": "2"}
    assert one(spark, K.hive_parts(F.col("k")), k="plain/key") == {}


def test_layout_keys(spark):
    lit = F.lit
    row = spark.range(1).select(
        K.bronze_key(lit("2026-01-02"), lit("e")).alias("b"),
        K.silver_key(lit("purchase"), lit("2026-01-02"), lit("e")).alias("s"),
        K.silver_quarantine_key(lit("a/b"), lit(" ")).alias("q"),
        K.gold_key(lit("purchase"), lit("2026-01-02")).alias("g"),
        K.gold_quarantine_key(lit(""), lit("a/b"), lit(None).cast("string")).alias("gq"),
        K.metric_day(lit("purchase"), lit("2026-01-02")).alias("m"),
        K.quarantine_event_id(lit("quarantine/reason=x/evt-9.json")).alias("id"),
    ).first()
    assert tuple(row) == (
        "events/dt=2026-01-02/e.json",
        "events/event_type=purchase/dt=2026-01-02/e.json",
        "quarantine/reason=a_b/unknown.json",
        "metrics/metric=purchase/dt=2026-01-02/part-000.json",
        "quarantine/reason=rejected_metric/metric=a_b/dt=unknown/part-000.json",
        "purchase#2026-01-02",
        "evt-9",
    )


def test_partition_grid(spark):
    grid = PT.projected_partitions(spark, "metric", date(2026, 1, 1), date(2026, 1, 2), ("a", "b"))
    assert sorted(map(tuple, grid.collect())) == [
        ("a", "2026-01-01"), ("a", "2026-01-02"), ("b", "2026-01-01"), ("b", "2026-01-02"),
    ]
    with pytest.raises(ValueError):
        PT.projected_partitions(spark, "metric", date(2026, 1, 2), date(2026, 1, 1))


def test_grid_from_data_rejects_reversed_days(spark):
    days = spark.range(1).select(F.lit(date(2026, 1, 2)).alias("start"), F.lit(date(2026, 1, 1)).alias("end"))
    with pytest.raises(Exception, match="end date"):
        PT.grid(days, "metric").collect()


def test_discovered_partitions(spark):
    keys = spark.createDataFrame(
        [("e/event_type=b/dt=2026-01-01/1",), ("e/event_type=b/dt=2026-01-01/2",), ("e/event_type=a/dt=2026-01-02/3",), ("e/4",)],
        "key STRING",
    )
    got = [tuple(r) for r in PT.discovered(keys, ("event_type", "dt")).collect()]
    assert got == [("b", "2026-01-01"), ("a", "2026-01-02")]


def test_objects_per_partition(spark):
    keys = spark.createDataFrame([("q/metric=m/dt=d/1", 5), ("q/metric=m/dt=d/2", 6), ("q/dt=d/3", 1), ("q/4", 1)], "path STRING, length BIGINT")
    got = {tuple(r) for r in PT.objects_per_partition(keys, ("metric", "dt"), ("dt",)).collect()}
    assert got == {("m", "d", 2, 11), ("unknown", "d", 1, 1)}
