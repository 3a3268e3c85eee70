"""The operators as stages over a table of documents.

Each takes (spark, docs, sf_dir) and applies its decisions to every row of docs; all but
the last return the columns of docs, `n_chars` following the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import carry, folds, minmax, packing, substrings, suffixes, toxicity


def _as_documents(result: DataFrame, docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of docs in their order, from doc_id, text and the carried ones."""
    columns = {c: F.col(carry.CARRIED).getField(c) for c in keep}
    columns |= {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return result.select(*(columns[c].alias(c) for c in docs.columns))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the fold that the query holds out is not learned from."""
    keep = carry.others(docs, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity(docs, labels, ~folds.held_out(4, 2), keep=keep)
    return _as_documents(scored.filter("predicted = 0"), docs, keep)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of lines; those of which nothing is left go.

    From one line on: a later copy goes also if it stands alone, between blank lines or as the whole text.
    """
    keep = carry.others(docs, "doc_id", "text")
    cut = suffixes.remove_repeated_lines(docs, min_lines=1, keep=keep)
    return _as_documents(cut.filter("n_removed = 0 OR n_removed < n_lines"), docs, keep)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, the first by id, nulls last; shingles of five words."""
    return minmax.without_near_duplicates(docs, size=5)


def without_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of words that an earlier one has; those of which nothing is left go."""
    keep = carry.others(docs, "doc_id", "text")
    cut = substrings.remove_repeats(docs, keep=keep)
    return _as_documents(cut.filter("n_removed = 0 OR n_removed < n_words"), docs, keep)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
