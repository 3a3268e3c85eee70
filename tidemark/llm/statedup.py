"""Exact dedup by a streaming query with keyed state.

The documents are read as a stream. A streaming aggregation keeps, without expiry and on
the executors' disks (RocksDB, uploaded to the checkpoint with every batch), one entry per
digest: how many rows had it, and of the row that stays its id and its content locator
(file and row number). Every batch appends the entries it changed to a ledger, under its
own batch number, so a batch that is repeated after a failure replaces what it wrote. A
hit, a row whose digest has another row's locator in the ledger, is then checked byte by
byte against the text at that locator. Texts that differ under one digest are grouped by
the text itself, so a weak digest costs time and never a row.

Hot groups: within a batch rows of a digest are combined before the exchange, so the
state receives one row per map task. Digests holding over one row in HOT_SHARE (at most
HOT_SHARE of them, whatever the input) reach the rows by broadcast, all others by an
exchange. Before that a bitmap of the repeated digests, of bounded size, is broadcast: a
row whose bit is not set has no copy and takes part in no exchange, and only the texts of
the others are carried to the check. When a larger input fills the bitmap, more rows take
that way, with the same result. In the check of bytes a group is split over one salt per SPLIT_ROWS rows, and
only its keeper is repeated. Called again with the same `root`, the stream goes on where
it stopped: only new files are read, and the ledger then covers all of them.

Defined results: a null text counts as empty, so null and empty texts are equal. Of equal
texts the row with the largest id stays; a null id is less than any other; of equal ids
the one with the larger locator stays, so exactly one row of a group is kept. An empty
table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize, scratch_path

#: Digests with more than one row in this many are broadcast; there are at most as many.
HOT_SHARE = 1024
#: Rows of a group that are compared with one copy of the kept text.
SPLIT_ROWS = 4096
#: Batches in which a table is read.
BATCHES = 4
#: Bits for each repeated digest, and the most bits: 2 ** 28 of them are 32 MB at every task.
BITS_EACH, MOST_BITS = 16, 1 << 28

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Keeps all stores of an executor within one memory bound; the rest is on disk.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Otherwise every store, however small, sets aside some megabytes of disk.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _located(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(place, text, digest) of every row; place orders the rows of a group, the last stays."""
    place = F.struct(
        F.col(f"`{id_col}`").alias("id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(place.alias("place"), text.alias("text"), digest(text).alias("digest"))


def _ledger_schema(id_type: T.DataType) -> T.StructType:
    place = T.StructType([T.StructField("id", id_type), T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
    return T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("copies", T.LongType()), T.StructField("keeper", place)])


def fold_into_ledger(
    spark: SparkSession,
    path: str,
    root: str,
    id_col: str,
    text_col: str,
    digest: Callable[[Column], Column],
    batches: int,
) -> DataFrame:
    """Run the stream over the files it has not seen; (digest, copies, keeper) of all seen so far."""
    table = spark.read.parquet(path)
    files_per_batch = max(1, -(-len(table.inputFiles()) // batches))
    schema = _ledger_schema(table.schema[id_col].dataType)
    none_yet = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    none_yet.write.mode("overwrite").parquet(f"{root}/ledger/batch=-1")

    # As a pattern the path may also be one file, which a stream does not take by name.
    pattern = path.rstrip("/")
    pattern = f"{pattern[:-1]}[{pattern[-1]}]"
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    rows = _located(source, id_col, text_col, digest).select("digest", "place")
    state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("place").alias("keeper"))

    def append(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{root}/ledger/batch={batch}")

    with _settings(spark, STATE_CONF):
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{root}/checkpoint")
            .foreachBatch(append)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    ledger = spark.read.schema(schema.add("batch", T.LongType())).parquet(f"{root}/ledger")
    # Of the entries a digest had in turn the last has most copies.
    newest = F.max_by(F.struct("copies", "keeper"), "copies").alias("newest")
    return ledger.groupBy("digest").agg(newest).select("digest", "newest.*")


def deduplicate(
    spark: SparkSession,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    batches: int = BATCHES,
    root: str | None = None,
) -> DataFrame:
    """One row per document of the Parquet table at `path`.

    Returns id, file and row (its locator), digest, keep_id, keep_file and keep_row (of
    the row that stays), group_size and kept. A `root` in the shared folder makes the
    state lasting.
    """
    root = root or scratch_path(spark, "statedup")
    ledger = fold_into_ledger(spark, path, root, id_col, text_col, digest, batches)
    repeated = materialize(ledger.filter("copies > 1"), "statedup-repeated")

    every = _located(spark.read.parquet(path), id_col, text_col, digest)
    marked = _marked(every, repeated)
    rows = marked.filter("maybe").drop("maybe")
    alone = marked.filter("NOT maybe").select(
        "digest", "place", F.lit(1).cast("long").alias("copies"), F.col("place").alias("keeper"), F.lit(None).cast("string").alias("text")
    )
    total = spark.read.parquet(path).count()
    hot = F.col("copies") * HOT_SHARE > F.lit(total)
    few = repeated.filter(hot).select("digest", F.struct("copies", "keeper").alias("hot"))
    rest = repeated.filter(~hot).select(F.col("digest").alias("key"), F.struct("copies", "keeper").alias("cold"))
    # A row that has met its hot digest takes a key of its own, which no digest equals.
    own_key = F.when(F.col("hot").isNotNull(), F.concat("digest", F.sha1(F.to_json("place")).cast("binary")))
    met = (
        rows.join(F.broadcast(few), "digest", "left")
        .withColumn("key", F.coalesce(own_key, F.col("digest")))
        .join(rest, "key", "left")
        .withColumn("entry", F.coalesce("hot", "cold", F.struct(F.lit(1).cast("long").alias("copies"), F.col("place").alias("keeper"))))
    )
    found = materialize(
        met.select(
            "digest", "place", "entry.copies", "entry.keeper", F.when(F.col("entry.copies") > 1, F.col("text")).alias("text")
        ).unionByName(alone),
        "statedup-found",
    )
    apart = materialize(_different(found), "statedup-different")
    if apart.isEmpty():
        return _decisions(found)
    # Texts that only share a digest: their groups are made of whole texts.
    groups = apart.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("copies"), F.max("place").alias("keeper"))
    gone = apart.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    regrouped = apart.join(groups, ["digest", "text"]).select("digest", "place", "copies", "keeper")
    left = found.join(apart.select("place"), "place", "left_anti").join(gone, "digest", "left")
    stayed = left.select("digest", "place", (F.col("copies") - F.coalesce("gone", F.lit(0))).alias("copies"), "keeper")
    return _decisions(stayed.unionByName(regrouped))


def _marked(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows with `maybe`, false for those whose digest is surely not repeated."""
    wanted = max(repeated.count(), 1) * BITS_EACH
    bits = min(1 << (wanted - 1).bit_length(), MOST_BITS)

    def place(digest: str) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(bits)) + 1

    at = place("digest")
    bitmap = repeated.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")
    )
    position = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bitmap", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # Of a byte the lowest bit comes first.
    bit = F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1))
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bitmap), "bucket", "left")
    return joined.withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("bucket", "bitmap")


def _different(found: DataFrame) -> DataFrame:
    """(digest, place, text) of the hits whose bytes are not those of the kept row."""
    salts = F.ceil(F.col("copies") / SPLIT_ROWS)
    repeated, is_keeper = found.filter("copies > 1"), F.col("place") == F.col("keeper")
    kept = repeated.filter(is_keeper).select(
        "digest", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.col("text").alias("kept_text")
    )
    hits = repeated.filter(~is_keeper).withColumn("salt", F.pmod(F.xxhash64("place"), salts))
    compared = hits.join(kept, ["digest", "salt"], "left")
    return compared.filter(~F.col("text").eqNullSafe(F.col("kept_text"))).select("digest", "place", "text")


def _decisions(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("place.id").alias("id"),
        F.col("place.file").alias("file"),
        F.col("place.row").alias("row"),
        "digest",
        F.col("keeper.id").alias("keep_id"),
        F.col("keeper.file").alias("keep_file"),
        F.col("keeper.row").alias("keep_row"),
        F.col("copies").alias("group_size"),
        (F.col("place") == F.col("keeper")).alias("kept"),
    )
