"""Exact dedup by streaming state, and whitening."""

from __future__ import annotations

import os
import tempfile
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import oracles, queries, statedup, whitening


def stored(frame, files=3):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    frame.repartition(files).write.parquet(f"{root}/documents.parquet")
    return root


def groups(rows):
    """Counter of (id, keep_id, group_size) and the number kept, by whole texts."""
    by_text = {}
    for i, text in rows:
        by_text.setdefault(text or "", []).append(i)
    found = Counter()
    for ids in by_text.values():
        keep = max((i for i in ids if i is not None), default=None)
        found.update((i, keep, len(ids)) for i in ids)
    return found, len(by_text)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, documents, texts, weak):
    path = stored(documents) + "/documents.parquet"
    # A digest of two values sends nearly every row to the check of bytes.
    digest = (lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 1) > F.unhex(F.lit("7F"))) if weak else None
    found = statedup.deduplicate(
        spark, path, **({"digest": lambda t: F.when(digest(t), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("02")))} if weak else {})
    )
    got = found.collect()
    want, kept = groups(texts)
    assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == kept
    places = {(r["file"], r["row"]) for r in got if r["kept"]}
    assert places == {(r["keep_file"], r["keep_row"]) for r in got}
    assert not weak or any(r["group_size"] > 1 for r in got)


def test_exact_query_equals_its_sql(spark, documents):
    root = stored(documents.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    got = queries.op11_statedup(spark, root)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet/*.parquet'")
    result = con.execute(oracles.EXACT_SQL)
    assert [c[0] for c in result.description] == got.columns
    assert sorted(result.fetchall()) == sorted(tuple(r) for r in got.collect())


def test_state_lasts_and_new_files_meet_it(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{root}/documents.parquet"
    schema = "doc_id LONG, text STRING"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], schema).coalesce(1).write.parquet(path)
    state = f"{root}/state"
    first = {r["id"]: r["keep_id"] for r in statedup.deduplicate(spark, path, root=state).collect()}
    assert first == {1: 3, 2: 2, 3: 3}
    spark.createDataFrame([(9, "b"), (0, "a"), (5, "c")], schema).coalesce(1).write.mode("append").parquet(path)
    rows = statedup.deduplicate(spark, path, root=state).collect()
    assert {r["id"]: (r["keep_id"], r["group_size"]) for r in rows} == {
        1: (3, 3), 2: (9, 2), 3: (3, 3), 9: (9, 2), 0: (3, 3), 5: (5, 1)
    }
    batches = {name for name in os.listdir(f"{state}/ledger") if name.startswith("batch=")}
    assert len(batches) == 3  # the empty one and one for each call


def test_one_text_in_most_rows(spark):
    rows = [(i, "the same" if i % 3 else f"text {i}") for i in range(30000)]
    path = stored(spark.createDataFrame(rows, "doc_id LONG, text STRING"), 4) + "/documents.parquet"
    got = statedup.deduplicate(spark, path)
    hot = got.filter("group_size > 1").agg(F.count(F.lit(1)), F.count_if("kept"), F.min("keep_id"), F.max("keep_id")).first()
    assert tuple(hot) == (20000, 1, 29999, 29999)
    assert got.filter("kept").count() == 10001


def test_exact_empty_table(spark, empty):
    assert statedup.deduplicate(spark, stored(empty, 1) + "/documents.parquet").collect() == []


# --- whitening -------------------------------------------------------------


def spectrum(values, seed=0):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 2, 30),
        [5, 5 + 1e-9, 5 - 1e-9, 3, 3, 3, *np.linspace(0.1, 1, 14)],
        [1e6, 1, 1 + 1e-7, 1e-3, 1e-5],
        [2, 2, 2, 2],
        [4, 1, 0, 0],
        [7],
    ],
)
def test_refined_eigenvectors(values):
    matrix = spectrum(np.array(values, float)).astype(whitening.Extended)
    found, vectors = whitening.eigenvectors(matrix)
    size = float(max(values))
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-16 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-16
    assert np.abs(found - np.sort(np.array(values, float))[::-1]).max() < 1e-14 * size
    plain = np.linalg.eigh(matrix.astype(np.float32))[1].astype(whitening.Extended)
    assert np.abs(matrix @ plain - plain * (plain * (matrix @ plain)).sum(axis=0)).max() > 1e-9 * size or len(values) < 5


def vectors_frame(spark, rows, parts=3):
    schema = "vec_id LONG, embedding ARRAY<FLOAT>, id STRING, n LONG, component STRING"
    return spark.createDataFrame([(i, v, "x", 1, "c") for i, v in rows], schema).repartition(parts)


def sample(count=300, d=12, seed=3):
    draw = np.random.default_rng(seed)
    table = draw.normal(size=(count, d)) * np.linspace(1, 4, d) + draw.normal(size=d)
    return [(i, [float(c) for c in row.astype(np.float32)]) for i, row in enumerate(table)]


def plain(rows):
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float64)) + 100000
    n = len(x)
    sums = x.sum(axis=0).astype(int).tolist()
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_against_plain_computation(spark):
    rows = sample()
    bad = [(900, None), (901, [None] + [1.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0])]
    again = [rows[0], (None, rows[1][1])]
    good = rows + again
    n, deviation, want, explained = plain(good)
    got = whitening.whiten_table(vectors_frame(spark, good + bad)).collect()
    assert len(got) == 8 * n
    assert max(r["identity_error"] for r in got) < 1e-12
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], {}).setdefault(r["component"], r)
    sign = {c: np.sign(by_id[5][c]["whitened"] * want[5][c - 1]) for c in range(1, 9)}
    for at, (i, _) in enumerate(good):
        for c in range(1, 9):
            row = by_id[i][c]
            assert row["n"] == n and row["deviation"] == deviation[at]
            assert abs(row["whitened"] * sign[c] - want[at][c - 1]) < 1e-9
            assert abs(row["explained"] / explained[c - 1] - 1) < 1e-9
    assert Counter(r["id"] for r in got)[0] == 16


def test_whitening_without_variance(spark):
    constant = [(i, [1.0, 2.0]) for i in range(5)]
    got = whitening.whiten_table(vectors_frame(spark, constant)).collect()
    assert len(got) == 10
    assert all((r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (0, None, None, 0.0) for r in got)
    flat = [(i, [float(i % 7), 0.0, 2.0 * (i % 7)]) for i in range(50)]
    got = whitening.whiten_table(vectors_frame(spark, flat)).collect()
    assert {r["component"]: r["whitened"] is None for r in got} == {1: False, 2: True, 3: True}
    assert got[0]["identity_error"] < 1e-12


def test_whitening_of_large_entries_and_empty_table(spark):
    huge = [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, 5.0])]
    got = whitening.whiten_table(vectors_frame(spark, huge)).collect()
    assert len(got) == 6 and {r["deviation"] for r in got if r["id"] == 0} == {None}
    none = whitening.whiten_table(vectors_frame(spark, [], 1))
    assert none.collect() == [] and none.columns == whitening.whiten_table(vectors_frame(spark, sample(20))).columns


def test_exact_sums_of_large_whole_numbers(spark):
    rows = [(i, [float(2**38 + i)]) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")
    sums = whitening._column_sums(frame.select(F.col("embedding").alias("vector"))).collect()
    assert int(sums[0]["total"]) == sum(1024 * (2**38 + i) + 100000 for i in range(100))
