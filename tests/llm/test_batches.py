"""Texts pass between Spark and Python in batches bounded by their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import folds, minmax, packing, substrings, toxicity
from tidemark.session import BATCH_BYTES_CONF, bound_batches


def _packing(docs, labels):
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _toxicity(docs, labels):
    return toxicity.toxicity(docs, labels, ~folds.held_out(4, 2))


OPERATORS = {
    "packing": _packing,
    "toxicity": _toxicity,
    "minmax": lambda docs, labels: minmax.near_duplicates(docs),
    "substrings": lambda docs, labels: substrings.remove_repeats(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_long_texts_come_in_several_batches(spark, name):
    key = BATCH_BYTES_CONF[0]
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        few = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id LONG, text STRING")
        labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id LONG, toxic INT")
        assert OPERATORS[name](few, labels).count() > 0

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

        # 40 MB of texts, fewer rows than the most that a batch may have.
        texts = spark.range(0, 4_000, 1, 1).select(F.repeat(F.lit("abcdefghi "), 1_000).alias("text"))
        got = texts.mapInArrow(sizes, "rows LONG, bytes LONG").collect()
        assert sum(r["rows"] for r in got) == 4_000
        assert max(r["bytes"] for r in got) < 10_000_000
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_a_session_keeps_its_own_bound(spark):
    key = BATCH_BYTES_CONF[0]
    before = spark.conf.get(key, None)
    spark.conf.set(key, "3m")
    try:
        few = spark.createDataFrame([(1, "a b c")], "doc_id LONG, text STRING")
        packing.pack_documents(few, public_tokenizers.path("word_bpe_49k.json"))
        assert spark.conf.get(key) == "3m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _pack_task(spark, monkeypatch):
    """The function that packing runs in a task."""
    few = spark.createDataFrame([(1, "a b c")], "doc_id LONG, text STRING")
    monkeypatch.setattr(type(few), "mapInArrow", lambda self, task, schema: task)
    monkeypatch.setattr(packing.TaskContext, "get", classmethod(lambda cls: cls))
    monkeypatch.setattr(packing.TaskContext, "partitionId", staticmethod(lambda: 0), raising=False)
    return packing.pack_documents(few, public_tokenizers.path("word_bpe_49k.json"))


def test_pieces_leave_in_batches_bounded_by_bytes(spark, monkeypatch):
    task = _pack_task(spark, monkeypatch)
    texts = ["abc def " * 500_000, None, *["some words here " * 2_000] * 200]
    ids = list(range(len(texts)))
    given = pa.record_batch([pa.array(ids), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = list(task(iter([given])))
    assert max(b.nbytes for b in got) < 1_500_000
    rows = [r for b in got for r in b.to_pylist()]
    assert sum(len(r["ids"]) for r in rows) > 5_000_000
    lengths = dict.fromkeys(ids, 0)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {r["doc_id"]: r["doc_tokens"] for r in rows}


def test_texts_come_in_batches_of_two_megabytes(spark):
    key = BATCH_BYTES_CONF[0]
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        bound_batches(spark)

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

        texts = spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("abcdefghi "), 1_000).alias("text"))
        got = texts.mapInArrow(sizes, "rows LONG, bytes LONG").collect()
        assert sum(r["rows"] for r in got) == 2_000
        assert max(r["bytes"] for r in got) < 2_500_000
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_words_in_use_stay_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 400)
    words = packing._WordIds(public_tokenizers.path("word_bpe_49k.json"))
    encoded = []
    plain = packing._WordIds._encode
    monkeypatch.setattr(packing._WordIds, "_encode", lambda self, w: encoded.append(w) or plain(self, w))
    for i in range(3_000):
        assert words["common"] == plain(words, "common")
        assert words[f"w{i}"] == plain(words, f"w{i}")
        assert words[""] == b""
        assert len(words) + len(words.older) <= 402
    assert encoded.count("common") == 1
