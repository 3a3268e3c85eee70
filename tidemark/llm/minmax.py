"""Near-duplicate components by min-max hashing.

Every permutation of the shingle hashes gives two values of a signature, its smallest
and its largest, so half as many permutations are evaluated. Bands of the signature
are buckets. Texts with equal shingle sets are one class from the start. In every
bucket all classes are compared with one pivot, the class that lies in the fullest
buckets; where a bucket still holds several components, the classes outside its
largest one are compared with all of its classes, in blocks of bounded size within
which only links between components are kept. Links are always confirmed on full
shingle sets. No pairs of a bucket are listed, and nothing is collected to the driver.

With the default bands a pair of similarity 0.8 shares no bucket with a chance of
about 5 in a million, and a chain of links rarely hangs on one pair alone.

Defined results of near_duplicates: a null or empty text, or one without words, has an empty set and is
linked with nothing. Rows with equal ids share the fate of their texts; a null id
counts as larger than any other, and a component of null ids alone has a null id. An
empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordhash
from tidemark.session import bound_batches, materialize

SHINGLE_WORDS = 4
BANDS = 40
ROWS = 6
#: Similarity in hundredths from which two sets are linked.
LINK_PERCENT = 80
#: Classes compared at once: this many outsiders with this many classes of a bucket.
BLOCK_OUTSIDERS = 512
BLOCK_MEMBERS = 4096


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of words."""
    return np.unique(wordhash.runs(wordhash.hashes(wordhash.words(text, lower=True)), size))


def set_key(shingles: np.ndarray) -> bytes:
    """128-bit name of a set; equal sets have equal names."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class MinMax:
    """Signatures by random linear permutations of 64-bit values."""

    def __init__(self, bands: int, rows: int, seed: int = 20240229) -> None:
        draw = np.random.default_rng(seed)
        count = -(-bands * rows // 2)
        self.factors = draw.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = draw.integers(0, 1 << 63, count, dtype=np.uint64)
        self.bands, self.rows = bands, rows

    def buckets(self, shingles: np.ndarray) -> np.ndarray:
        """One bucket per band as a signed 64-bit value; `shingles` is not empty."""
        low = np.full(len(self.factors), ~np.uint64(0))
        high = np.zeros(len(self.factors), np.uint64)
        for at in range(0, len(shingles), 8192):  # bounds the memory that a long text takes
            values = np.multiply.outer(self.factors, shingles[at : at + 8192]) + self.offsets[:, None]
            np.minimum(low, values.min(axis=1), out=low)
            np.maximum(high, values.max(axis=1), out=high)
        signature = np.stack([low, high], axis=1).ravel()[: self.bands * self.rows].reshape(self.bands, self.rows)
        total = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            total = wordhash.mix(total + signature[:, i])
        return total.view(np.int64)


def signatures(docs: DataFrame, *, bands: int, rows: int, size: int) -> DataFrame:
    """(doc_id, row, n_shingles, class, buckets) of every (doc_id, text, row); an empty set has null buckets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinMax(bands, rows)
        for batch in batches:
            sizes, keys, found = [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), size)
                sizes.append(len(shingles))
                keys.append(set_key(shingles))
                found.append(hasher.buckets(shingles) if len(shingles) else None)
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                ["doc_id", "row", "n_shingles", "class", "buckets"],
            )

    return docs.mapInArrow(sign, "doc_id LONG, row LONG, n_shingles LONG, class BINARY, buckets ARRAY<LONG>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(class, shingles) of the wanted (class, row) rows, one row per class."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column(1)]
            keys = [set_key(s) for s in sets]
            # Texts may share a row's name, by chance; the class tells which was meant.
            mine = [i for i, key in enumerate(batch.column(0).to_pylist()) if keys[i] == key]
            yield pa.record_batch(
                [
                    pa.array([keys[i] for i in mine], pa.binary()),
                    pa.array([sets[i].view(np.int64) for i in mine], pa.list_(pa.int64())),
                ],
                ["class", "shingles"],
            )

    # One row stands for a class, so ids that are null or repeated bring no other texts along.
    texts = docs.join(wanted, "row")
    built = texts.select("class", "text").mapInArrow(build, "class BINARY, shingles ARRAY<LONG>")
    return built.groupBy("class").agg(F.first("shingles").alias("shingles"))


def _linked(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _pivot_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed (a, b) links between the members of buckets and their pivots."""
    pairs = members.filter(F.col("class") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    first = sets.select(F.col("class").alias("a"), F.col("shingles").alias("a_set"))
    second = sets.select(F.col("class").alias("b"), F.col("shingles").alias("b_set"))
    joined = pairs.join(first, "a").join(second, "b")
    return joined.filter(_linked(F.col("a_set"), F.col("b_set"), percent)).select("a", "b")


def link_components(links: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(class, component): the smallest class that a node reaches, over (a, b) links.

    Hook and jump: each node takes the smallest label around it, then its label's label.
    Rounds grow with the logarithm of a component's width; nodes without links keep themselves.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.distinct(), f"{name}-edges")
    labels = materialize(nodes.select("class", F.col("class").alias("component")), f"{name}-labels")
    while True:
        around = (
            edges.join(labels.withColumnRenamed("class", "b"), "b")
            .groupBy(F.col("a").alias("class"))
            .agg(F.min("component").alias("seen"))
        )
        hooked = labels.join(around, "class", "left").select(
            "class", F.col("component").alias("old"), F.least("component", F.coalesce("seen", "component")).alias("near")
        )
        # The smallest label that any node of an old component has seen moves that whole component.
        best = hooked.groupBy(F.col("old").alias("root")).agg(F.min("near").alias("best"))
        jumped = best.join(
            best.select(F.col("root").alias("best"), F.col("best").alias("further")), "best", "left"
        ).select("root", F.coalesce("further", "best").alias("component"))
        moved = hooked.join(jumped, hooked["old"] == jumped["root"]).select("class", "old", "component")
        moved = materialize(moved, f"{name}-labels")
        labels = moved.select("class", "component")
        if moved.filter(F.col("old") != F.col("component")).isEmpty():
            return labels


def _outsider_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that pivots have missed, in buckets that still hold several components.

    `members`: bucket, class, pivot, component. The classes outside a bucket's largest
    component meet all of its classes, dealt out in blocks of bounded size.
    """
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    whole = parts.groupBy("bucket").agg(
        F.sum("n").alias("size"),
        F.count("*").alias("components"),
        F.max(F.struct("n", "component")).alias("top"),
    )
    # With two classes the pivot has met the only other one.
    open_buckets = whole.filter("components > 1 AND size > 2").select(
        "bucket",
        F.col("top.component").alias("main"),
        F.ceil((F.col("size") - F.col("top.n")) / BLOCK_OUTSIDERS).cast("long").alias("outer_blocks"),
        F.ceil(F.col("size") / BLOCK_MEMBERS).cast("long").alias("inner_blocks"),
    )
    left = members.filter(F.col("class") != F.col("pivot")).join(open_buckets, "bucket")
    spread = F.abs(F.xxhash64("class"))
    # One row for each block a class takes part in: as an outsider, and as one to be met.
    as_outsider = left.filter(F.col("component") != F.col("main")).select(
        "bucket", "class", "component", F.lit(True).alias("outsider"),
        (spread % F.col("outer_blocks")).alias("outer"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("inner_blocks") - 1)).alias("inner"),
    )
    as_member = left.select(
        "bucket", "class", "component", F.lit(False).alias("outsider"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer_blocks") - 1)).alias("outer"),
        (spread % F.col("inner_blocks")).alias("inner"),
    )
    dealt = as_outsider.unionByName(as_member).join(sets, "class")

    def meet(block: pa.Table) -> pa.Table:
        outside = np.array(block.column("outsider").to_pylist(), bool)
        classes, names = block.column("class").to_pylist(), block.column("component").to_pylist()
        lists = block.column("shingles").combine_chunks()
        flat = lists.flatten().to_numpy()
        sizes = np.array(lists.value_lengths().to_pylist(), np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inner = ~outside[owner]
        order = np.argsort(flat[inner], kind="stable")
        sought, owners = flat[inner][order], owner[inner][order]
        ends = np.cumsum(sizes)
        parent = {c: c for c in names}

        def root(c: bytes) -> bytes:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found: list[tuple[bytes, bytes]] = []
        for x in np.flatnonzero(outside).tolist():
            mine = flat[ends[x] - sizes[x] : ends[x]]
            low, high = np.searchsorted(sought, mine, "left"), np.searchsorted(sought, mine, "right")
            counts = high - low
            where = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            common = np.bincount(owners[where], minlength=len(sizes))
            near = 100 * common >= percent * (sizes[x] + sizes - common)
            for y in np.flatnonzero(near & ~outside).tolist():
                a, b = root(names[x]), root(names[y])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((classes[x], classes[y]))
        return pa.table(
            [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["a", "b"]
        )

    return dealt.groupBy("bucket", "outer", "inner").applyInArrow(meet, "a BINARY, b BINARY")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names a row's id and text together."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of docs, all columns, with one row left of each component.

    The row left is the first by (id, nulls last, class, row); rows equal in these by a hash of all
    columns. Rows without a word are in no component and stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).filter("n_shingles > 0")
    places = materialize(
        found.groupBy("doc_id", "row", "class", "component").agg(F.count("*").alias("n")), "minmax-places"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "class", "row", "n")).alias("first")
    left = materialize(places.groupBy("component").agg(first).select("first.doc_id", "first.row", "first.n"), "minmax-left")

    def same(one: DataFrame, other: DataFrame) -> Column:
        return (one["row"] == other["row"]) & one["doc_id"].eqNullSafe(other["doc_id"])

    gone = places.join(left, same(places, left), "left_anti").select("doc_id", "row")
    again = materialize(left.filter("n > 1").select("doc_id", "row"), "minmax-again")
    out = materialize(gone.unionByName(again), "minmax-gone")
    # Packed, the columns of docs cannot clash with these two.
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"),
        F.col(id_col).cast("long").alias("doc_id"),
        row_key(id_col, text_col).alias("row"),
    )
    single = rows.join(out, same(rows, out), "left_anti").select("all")
    repeated = rows.join(again, same(rows, again), "left_semi")
    one = repeated.groupBy("doc_id", "row").agg(F.min_by("all", F.xxhash64("all")).alias("all")).select("all")
    return single.unionByName(one).select("all.*")


def near_duplicates(
    docs: DataFrame,
    *,
    size: int = SHINGLE_WORDS,
    percent: int = LINK_PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, row, n_shingles, class, component, component_id, kept) of every row.

    `row` is row_key of the row; `class` names the set of shingles, `component` the component (null if the
    set is empty); `kept` holds where doc_id is the component's smallest.
    """
    bound_batches(docs.sparkSession)
    row = row_key(id_col, text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    signed = materialize(signatures(docs, bands=bands, rows=rows, size=size), "minmax-signatures")
    filled = signed.filter("n_shingles > 0")
    # All rows of a class have the same buckets.
    classes = materialize(
        filled.groupBy("class").agg(
            F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("buckets").alias("buckets")
        ),
        "minmax-classes",
    )
    placed = classes.select("class", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("filled")).filter("filled > 1")
    members = materialize(placed.join(shared, "bucket"), "minmax-members")
    weights = members.groupBy("class").agg(F.sum("filled").alias("weight"))
    pivots = (
        members.join(weights, "class")
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", "class"))["class"].alias("pivot"))
    )
    members = materialize(members.select("bucket", "class").join(pivots, "bucket"), "minmax-pivots")
    nodes = members.select("class").distinct()
    sets = materialize(shingle_sets(docs, classes.select("class", "row").join(nodes, "class", "left_semi"), size), "minmax-sets")

    links = materialize(_pivot_links(members, sets, percent), "minmax-links")
    labels = link_components(links, nodes, "minmax")
    more = materialize(_outsider_links(members.join(labels, "class"), sets, percent), "minmax-more")
    if not more.isEmpty():
        # Components are the nodes now.
        ends = labels.withColumnRenamed("class", "node")
        bridges = (
            more.join(ends.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a")
            .join(ends.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
            .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        )
        joined = link_components(bridges, labels.select(F.col("component").alias("class")).distinct(), "minmax-bridged")
        labels = labels.join(
            joined.select(F.col("class").alias("component"), F.col("component").alias("final")), "component"
        ).select("class", F.col("final").alias("component"))

    named = classes.select("class", "doc_id").join(labels, "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = materialize(named.join(smallest, "component").select("class", "component", "component_id"), "minmax-components")
    joined = signed.select("doc_id", "row", "n_shingles", "class").join(known, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "row", "n_shingles", "class", "component", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
