"""The corpus pipeline: toxicity, line dedup, near-dedup, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.session import materialize

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.without_toxic),
    ("line_dedup", stages.without_repeated_lines),
    ("near_dedup", stages.without_near_duplicates),
    ("substring_dedup", stages.without_repeated_windows),
    ("packing", stages.packed),
]

#: Toxicity and packing cannot be written in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
