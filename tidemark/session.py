"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that change results, so every entry point applies them.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for key, value in SEMANTIC_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: Most bytes of rows that go from Spark to Python at once. By default 10,000 rows do, whatever
#: their size; a batch of texts is then held several times over, beside the heap.
BATCH_BYTES_CONF = ("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of texts by bytes, where the session does not itself."""
    key, most = BATCH_BYTES_CONF
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)


def build_session(app: str = "tidemark", **conf: str) -> SparkSession:
    """Session with the semantic settings; sizing comes from the cluster."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SEMANTIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while, such as those a stream takes over when it starts."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and stream checkpoints.

    The cluster names it in spark.checkpoint.dir. Only a local session may fall
    back to a folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and gives Catalyst the
    real byte size, so a later join broadcasts the side only if it is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
