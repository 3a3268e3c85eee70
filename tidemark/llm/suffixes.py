"""Removal of repeated runs of lines by a suffix array over line ids.

Lines become 64-bit ids; only lines that occur twice or more can lie in a repeated run,
so only their positions are ranked. Distributed prefix doubling sorts the suffixes:
the rank of a position's first 2h lines comes from the ranks of its first h lines and
of the h lines after them, the distinct pairs being sorted by range and numbered in that
order. A position whose rank nobody shares needs no more lines and is left out of the
next round, so rounds shrink; they end when no rank is shared. The order of the last
ranks of all positions is the suffix array.

Equal ranks after h lines are a longest-common-prefix interval of depth h or more. In
every interval the first position, by document id and line, is the original; the lines
of later copies in intervals of `min_lines` and deeper are deleted. Deeper intervals
show how long the shared runs are.

Everything is DataFrame operations. A line's id stands for its text (64-bit hash).

Defined results: lines are split at \\n; a null or empty text stays as it is; a line
without a word has no id, so it ends every run and stays; a null document id sorts
before all others; rows of equal id and text are one document and keep the same lines;
an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import carry
from tidemark.session import materialize

#: Lines of the shortest run that is deleted.
MIN_LINES = 2

_WORD = r"[^ \t-\r]"


def _place(name: str = "place"):
    return F.struct("doc_id", "row", "at").alias(name)


def line_positions(rows: DataFrame) -> DataFrame:
    """(row, doc_id, at, line): the id of every line with a word and its number in the text."""
    lines = F.transform(F.split("text", "\n"), lambda line: F.when(line.rlike(_WORD), F.xxhash64(line)))
    return rows.select("row", "doc_id", F.posexplode(lines).alias("at", "line")).filter("line IS NOT NULL")


def _number(keys: DataFrame) -> DataFrame:
    """Adds `rank` to distinct (first, second) keys, ascending in their order.

    Range partitions sorted inside make one sorted sequence, which generated ids follow.
    """
    ordered = keys.repartitionByRange("first", "second").sortWithinPartitions("first", "second")
    return ordered.withColumn("rank", F.monotonically_increasing_id())


def shared_runs(positions: DataFrame, min_lines: int) -> DataFrame:
    """(row, at, shared): lines that a position shares with an earlier one, `min_lines` or more.

    `shared` is the depth of the deepest round in which an earlier position has its rank.
    """
    repeated = positions.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line")
    left = positions.join(repeated, "line").select("row", "doc_id", "at", F.col("line").alias("rank")).distinct()
    left = materialize(left, "suffix-ranks")
    depth, found = 1, []
    while not left.isEmpty():
        if depth >= min_lines:
            first = left.groupBy("rank").agg(F.min(_place()).alias("first"))
            later = left.join(first, "rank").filter(_place() > F.col("first"))
            found.append(later.select("row", "at", F.lit(depth).alias("shared")))
        # Short of the wanted depth the step may be cut, so that ranks stand for just that many lines.
        step = depth if depth >= min_lines else min(depth, min_lines - depth)
        after = left.select("row", (F.col("at") - step).alias("at"), F.col("rank").alias("second"))
        pairs = left.withColumnRenamed("rank", "first").join(after, ["row", "at"])
        often = pairs.groupBy("first", "second").agg(F.count("*").alias("n")).filter("n > 1")
        named = materialize(_number(often.select("first", "second")), "suffix-names")
        left = pairs.join(named, ["first", "second"]).select("row", "doc_id", "at", "rank")
        left = materialize(left, "suffix-ranks")
        depth += step
    if not found:
        return positions.select("row", "at", F.lit(0).alias("shared")).limit(0)
    return reduce(DataFrame.unionByName, found).groupBy("row", "at").agg(F.max("shared").alias("shared"))


def remove_repeated_lines(
    docs: DataFrame,
    *,
    min_lines: int = MIN_LINES,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """(doc_id, n_lines, n_removed, longest_shared, text, carried) of every row.

    `carried` holds the columns `keep`.
    `n_lines` counts the lines with a word, `longest_shared` is the most lines that a
    position shares with an earlier one (0 if fewer than `min_lines`).
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        carry.packed(docs, keep or []),
    )
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    shared = shared_runs(line_positions(rows), min_lines)
    # Each list is bounded by its own text's lines.
    gone = shared.groupBy("row").agg(
        F.array_sort(
            F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + (min_lines - 1)))))
        ).alias("gone"),
        F.max("shared").alias("longest_shared"),
    )
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    marked = rows.join(gone, "row", "left").withColumn("lines", F.when(F.col("gone").isNotNull(), lines))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    )
    return marked.select(
        "doc_id",
        F.coalesce(F.size(F.filter(lines, lambda line: line.rlike(_WORD))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("longest_shared", F.lit(0)).cast("long").alias("longest_shared"),
        text.alias("text"),
        carry.CARRIED,
    )
