"""Keys, replays and last-write-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import digest
from tidemark.schemas import SUCCESS_STATUSES

SILVER_IDENTITY = ("event_type", "dt", "event_id")


def last_write(df: DataFrame, keys: tuple[str, ...], order: tuple[str | Column, ...]) -> DataFrame:
    """One row per key, the one latest in ``order``.

    An aggregate rather than a ranking window: copies of a key collapse on the
    map side, so a key with a third of all rows reaches its reducer as one row
    per map task. A hash of the content breaks ties, so the same rows give the
    same winner however they are dealt.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.xxhash64(*rest).alias("_tie"))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def succeeded_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status").isin(*SUCCESS_STATUSES)).select("run_id").distinct()


def pending_work(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Candidates whose run has not succeeded yet."""
    return candidates.join(succeeded_runs(runs), "run_id", "left_anti")


def replays(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Candidates that are retries of a succeeded run."""
    return candidates.join(succeeded_runs(runs), "run_id", "left_semi")


def batch_identity(parts: DataFrame, batch: str, key: str, scope: str) -> DataFrame:
    """Idempotency key and run id of each bounded batch of object keys.

    For batches bounded by construction, such as a queue drain of ten messages;
    repeated deliveries of a key count once. Sets without a bound use
    `manifest_identity`.
    """
    distinct = parts.select(batch, key).distinct()
    grouped = distinct.groupBy(batch).agg(F.collect_list(key).alias("_parts"))
    return grouped.select(
        batch,
        F.size("_parts").cast("bigint").alias("parts"),
        digest.idempotency_key(scope, F.col("_parts")).alias("idempotency_key"),
        digest.run_id(scope, F.col("_parts")).alias("run_id"),
    )


def manifest_identity(parts: DataFrame, group: tuple[str, ...], key: str, scope: str) -> DataFrame:
    """Run id of each unbounded set of object keys, by partial aggregation."""
    sums = parts.groupBy(*group).agg(*digest.manifest_sums(F.col(key)))
    return sums.select(*group, "parts", digest.manifest_id(scope).alias("run_id"))
