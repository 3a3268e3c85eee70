"""The registered queries of the operators and their SQL.

Each query applies its operator with production parameters to its whole table and
derives the digest columns of its result from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    folds,
    imatch,
    lattice,
    mincut,
    minmax,
    oracles,
    packing,
    pieces,
    repair,
    rules,
    statedup,
    substrings,
    suffixes,
    toxicity,
    whitening,
)

PACK_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), PACK_TOKENIZER)
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    kept = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), "")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(kept, " "), 256).alias("kept_sha256"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_documents(_table(spark, sf_dir, "documents"), PIECE_MODEL)
    both = pieces.decode_documents(encoded, PIECE_MODEL)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mincut.extract_pages(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(_table(spark, sf_dir, "documents"), PIECE_MODEL, folds.held_out(5, 1), class_col="lang")


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeated_lines(_table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cut.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = folds.held_out(4, 2)
    scored = toxicity.toxicity(docs, labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge_documents(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op11_statedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statedup.deduplicate(spark, f"{sf_dir}/documents.parquet")
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", digest)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.repair_conversations(repair.damage(_table(spark, sf_dir, "conversations")))
    whole = found.whole.withColumn("repaired_sha256", F.sha2(repair.lines("turns"), 256)).drop("turns")
    hashed = repair.digests(found.pieces).select(F.col("conv").alias("c"), F.col("sha256").alias("repaired_sha256"))
    split = found.split.join(hashed, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    return whole.unionByName(split).withColumnRenamed("conv", "conv_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_table(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op8_packing": op8_packing,
    "op10_pieces": op10_pieces,
    "op1_mincut": op1_mincut,
    "op3_imatch": op3_imatch,
    "op4_suffixes": op4_suffixes,
    "op5_toxicity": op5_toxicity,
    "op2_lattice": op2_lattice,
    "op9_substrings": op9_substrings,
    "op6_minmax": op6_minmax,
    "op7_rules": op7_rules,
    "op11_statedup": op11_statedup,
    "op12_repair": op12_repair,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op4_suffixes": oracles.LINES_SQL,
    "op6_minmax": oracles.NEAR_SQL,
    "op7_rules": oracles.RULES_SQL,
    "op9_substrings": oracles.SUBSTRINGS_SQL,
    "op11_statedup": oracles.EXACT_SQL,
}
