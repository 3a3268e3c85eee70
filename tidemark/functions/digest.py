"""Content identity of a batch.

`content_hash`, `idempotency_key` and `run_id` work on an array of parts held
in one row, so they suit batches whose size is bounded (a queue drain takes ten
messages). A hash chain over sorted parts cannot be split over tasks, so the
identity of an unbounded set (a whole window of keys) is `manifest_sums` +
`manifest_id`: a sum of part hashes, which partial aggregation handles in
constant memory whatever one group's share is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _framed(part: Column) -> Column:
    """A part behind its length as 4 bytes, most significant first."""
    length = F.lpad(F.hex(F.octet_length(part)), 8, "0")
    return F.concat(F.unhex(length), F.encode(part, "UTF-8"))


def content_hash(parts: Column) -> Column:
    """SHA-256 hex over length-prefixed parts, order kept."""
    empty = F.encode(F.lit(""), "UTF-8")
    return F.sha2(F.aggregate(parts, empty, lambda acc, p: F.concat(acc, _framed(p))), 256)


def idempotency_key(scope: str, parts: Column) -> Column:
    """scope#hash over the scope, then the non-empty parts sorted."""
    kept = F.array_sort(F.filter(parts, lambda p: p.isNotNull() & (p != "")))
    return F.concat(F.lit(f"{scope}#"), content_hash(F.concat(F.array(F.lit(scope)), kept)))


def run_id(scope: str, parts: Column) -> Column:
    """scope- and the first 16 hex digits of the idempotency key's hash."""
    digest = F.substring_index(idempotency_key(scope, parts), "#", -1)
    return F.concat(F.lit(f"{scope}-"), F.substring(digest, 1, 16))


def _limb(part: Column, index: int) -> Column:
    piece = F.substring(F.sha2(part, 256), 1 + 15 * index, 15)
    return F.conv(piece, 16, 10).cast("decimal(38,0)")


def manifest_sums(part: Column) -> list[Column]:
    """Aggregates that identify a multiset of parts, in any order."""
    kept = F.when(part.isNotNull() & (part != ""), part)
    return [F.count(kept).alias("parts")] + [
        F.coalesce(F.sum(_limb(kept, i)), F.lit(0).cast("decimal(38,0)")).alias(f"limb_{i}")
        for i in range(4)
    ]


def manifest_id(scope: str) -> Column:
    """scope- and 16 hex digits over the aggregates of `manifest_sums`."""
    text = F.concat_ws("|", F.lit(scope), F.col("parts"), *[F.col(f"limb_{i}") for i in range(4)])
    return F.concat(F.lit(f"{scope}-"), F.substring(F.sha2(text, 256), 1, 16))
