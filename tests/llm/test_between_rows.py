"""Operators that compare rows: fingerprints, lines, near-duplicates, windows, the pipeline."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import imatch, minmax, stages, substrings, suffixes, wordhash
from tests.llm.conftest import prose


def test_near_duplicates_against_all_pairs(documents, empty, texts):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 4]) for k in range(max(len(w) - 3, min(len(w), 1))))

    sets = [shingles(t) for _, t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = defaultdict(lambda: None)
    for (i, _), g in zip(texts, group, strict=True):
        if i is not None and (least[g] is None or i < least[g]):
            least[g] = i
    want = Counter((i, len(s), least[g] if s else i) for (i, _), s, g in zip(texts, sets, group, strict=True))
    got = minmax.near_duplicates(documents).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minmax.near_duplicates(empty).collect() == []


def test_group_whose_members_are_not_near_the_pivot(spark):
    # Edits of one text: many pairs lie below the limit, chains still hold them together.
    draw = np.random.default_rng(4)
    base, rows = prose(3, 200), []
    for i in range(80):
        words = list(base)
        for at in draw.choice(200, int(draw.integers(1, 8)), replace=False):
            words[at] = f"new{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    sets = {i: set(minmax.shingle_set(t).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    assert len(set(root.values())) < 80
    got = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(docs).collect()}
    assert got == root


def test_near_stage_decides_by_row(spark):
    a, near, b, c = prose(500, 80), prose(500, 80)[:-1] + ["other"], prose(501, 80), prose(502, 80)
    a, near, b, c, d, e = (" ".join(x) for x in (a, near, b, c, prose(503, 80), prose(504, 80)))
    rows = [
        (1, a, "first"), (None, near, "x"), (None, b, "alone"), (7, a, "x"), (7, c, "alone"),
        (8, d, "same"), (8, d, "same"), (None, e, "same"), (None, e, "same"), (None, e.upper(), "same"),
        (9, "", "empty"), (9, "", "empty"), (None, None, "empty"),
    ]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, row STRING")
    out = stages.without_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], (r["text"] or "").lower(), r["row"]) for r in out.collect())
    assert got == Counter([
        (1, a, "first"), (None, b, "alone"), (7, c, "alone"), (8, d, "same"), (None, e, "same"),
        (9, "", "empty"), (9, "", "empty"), (None, "", "empty"),
    ])


def test_min_and_max_agree_as_often_as_sets_do():
    a = wordhash.mix(np.arange(1000, dtype=np.uint64))
    b = wordhash.mix(np.arange(200, 1200, dtype=np.uint64))
    hasher = minmax.MinMax(2000, 1)
    same = (hasher.buckets(a) == hasher.buckets(b)).mean()
    assert abs(same - 800 / 1200) < 0.05


def test_windows_against_counting(documents, empty, texts):
    first = {}
    for i, t in texts:
        w = (t or "").split(" ") if False else (t or "").encode().split()
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t in texts:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want[(i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    got = substrings.remove_repeats(documents).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], b" ".join((r["text"] or "").encode().split())) for r in got) == want
    assert sum(n for _, _, n, _ in want.elements()) > 0
    assert substrings.remove_repeats(empty).collect() == []


def test_full_sketch_loses_nothing(documents):
    a = substrings.remove_repeats(documents, bits=16).drop("carried").collect()
    b = substrings.remove_repeats(documents, bits=24).drop("carried").collect()
    assert Counter(a) == Counter(b)


def test_line_runs_against_counting(documents, empty, texts):
    seen = sorted(
        {(t or "", -1 if i is None else i, i) for i, t in texts}, key=lambda x: (x[1], x[0])
    )
    worded = lambda s: bool(s.split(None) or s.strip(" \t\n\r\x0b\x0c"))
    places = defaultdict(list)
    for t, order, i in seen:
        lines = t.split("\n")
        for k in range(len(lines) - 1):
            if worded(lines[k]) and worded(lines[k + 1]):
                places[(lines[k], lines[k + 1])].append((order, t, k))
    gone = defaultdict(set)
    for found in places.values():
        first = min(found, key=lambda p: p[0])
        for order, t, k in found:
            if (order, k) != (first[0], first[2]):
                gone[(order, t)].update((k, k + 1))
    got = suffixes.remove_repeated_lines(documents).collect()
    want = Counter()
    for i, t in texts:
        out = gone[(-1 if i is None else i, t or "")]
        want[(i, len(out), "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in out))] += 1
    assert Counter((r["doc_id"], r["n_removed"], r["text"] or "") for r in got) == want
    assert {r["longest_shared"] for r in got if r["doc_id"] == 31} == {4}
    assert suffixes.remove_repeated_lines(empty).collect() == []


def test_line_stage_takes_single_lines_and_paragraphs_between_blank_lines(spark):
    one, two = " ".join(prose(300, 12)), " ".join(prose(301, 12))
    rows = [(1, f"{one}\n\n{two}"), (2, f"first own\n\n{one}\n\n{two}\n\nlast own"), (3, one), (4, f"own\n{two}\nmore"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    left = {r["doc_id"]: r["text"] for r in stages.without_repeated_lines(spark, docs, "").collect()}
    assert left == {1: rows[0][1], 2: "first own\n\n\n\nlast own", 4: "own\nmore", 5: None}


def test_longer_runs_only(documents):
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeated_lines(documents, min_lines=5).collect()}
    assert got[31] == 6 and got[32] == 0


def test_fingerprints(documents, empty, texts):
    got = imatch.fingerprint_documents(documents).collect()
    assert len(got) == len(texts)
    prints = defaultdict(set)
    for r in got:
        prints[(r["doc_id"], r["n_chars"])].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values())
    own = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert own[5]["fingerprint"] == own[9]["fingerprint"]
    assert own[61]["near_next"] in (0.0, 1.0)
    known = sorted({(i, t) for i, t in texts if i is not None}, key=lambda x: x[0])
    for (i, t), (_, after) in zip(known, known[1:], strict=False):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert own[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert imatch.fingerprint_documents(empty).collect() == []


def test_fingerprints_of_copies_and_of_texts_without_band_terms(spark):
    # Two groups of copies hold a fifth of the rows each; the others share no term with anything.
    one, two = " ".join(prose(400, 40)), " ".join(prose(401, 40))
    rows = [(i, one) for i in range(100)] + [(100 + i, two) for i in range(100)] + [(200 + i, f"only{i} here{i}") for i in range(300)]
    rows += [(500, ""), (501, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r["doc_id"]: r for r in imatch.fingerprint_documents(docs).collect()}
    prints = defaultdict(set)
    for i, t in rows:
        prints[t or ""].add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert len({min(p) for p in prints.values()}) == len(prints) == 303
    assert all(got[i]["near_next"] == 1 for i in (*range(99), *range(100, 199), 500))
    assert all(got[i]["near_edited"] == 1 for i in (500,))
    assert all(got[i]["near_next"] == 0 for i in (*range(200, 500), 501))
    assert set(got[0]["fingerprint"].split()) != {"-"}


def test_copies_do_not_move_the_band(spark):
    rows = [(i, f"word{i} shared{i // 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    more = spark.createDataFrame([(1000 + i, rows[0][1]) for i in range(300)], "doc_id LONG, text STRING")
    before, after = (
        {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint_documents(d).collect()} for d in (docs, docs.unionByName(more))
    )
    assert {i: after[i] for i in before} == before


def test_one_document_follows_itself(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc_id LONG, text STRING")
    row = imatch.fingerprint_documents(docs).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


def test_pipeline_stages_take_effect(spark, documents, texts, tmp_root):
    import corpus_pipeline

    docs = documents.select("doc_id", "text", "lang").selectExpr("*", "'s' AS source", "length(text) AS n_chars")
    docs.write.parquet(f"{tmp_root}/documents.parquet")
    labels = [(20, 0), (60, 0)]
    spark.createDataFrame(labels, "doc_id LONG, toxic INT").write.parquet(f"{tmp_root}/labels.parquet")
    frame, seen = spark.read.parquet(f"{tmp_root}/documents.parquet"), {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, tmp_root)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_root}/{number}")
        frame = seen[name] = spark.read.parquet(f"{tmp_root}/{number}")
    left = {r["doc_id"] for r in seen["substring_dedup"].collect()}
    assert {20, 30, 60} <= left and not {9, 12} & left
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"].collect() if r["text"] is not None)
    run = {r["doc_id"] for r in corpus_pipeline.run(spark, tmp_root).collect()}
    assert run == {r["doc_id"] for r in seen["packing"].collect()}


def test_many_null_and_repeated_ids_stay_linear(spark):
    rows = [(None, " ".join(prose(10_000 + i // 2, 12))) for i in range(20_000)]
    rows += [(7, f"the same id with other words each time number {i} of them all") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    classes = spark.createDataFrame(
        [(minmax.set_key(minmax.shingle_set(t)), t) for _, t in rows[:4000:2]], "class BINARY, text STRING"
    )
    keyed = docs.withColumn("row", minmax.row_key())
    wanted = classes.select("class", F.xxhash64(F.lit(None).cast("long"), "text").alias("row"))
    assert minmax.shingle_sets(keyed, wanted, 4).count() == 2000
    found = minmax.near_duplicates(docs).agg(F.count("*"), F.countDistinct("class"), F.countDistinct("component")).first()
    assert tuple(found) == (20_500, 10_500, 10_500)


def test_fingerprints_of_repeated_rows(spark):
    texts = [" ".join(prose(40 + i, 30)) for i in range(3)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([r for r in rows for _ in range(1000)], "doc_id LONG, text STRING")
    once = {r["doc_id"]: r for r in imatch.fingerprint_documents(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    got = imatch.fingerprint_documents(docs)
    assert got.groupBy("doc_id").count().filter("count = 1000").count() == 3
    assert {r["doc_id"]: r for r in got.dropDuplicates(["doc_id"]).collect()} == once


def test_fingerprints_against_plain_computation(spark, documents, texts):
    """Likeness and equality of fingerprints from sets of words alone."""
    docs = documents.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in imatch.fingerprint_documents(docs).collect()}
    plain = {i: (t or "") for i, t in texts if i is not None}
    order = sorted(plain)
    words = {i: frozenset(plain[i].lower().split()) for i in order}
    for at, i in enumerate(order):
        following = order[(at + 1) % len(order)]
        half = len(plain[i]) // 2
        edited = plain[i][: len(plain[i]) - half] + plain[following][:half]
        row = got[i]
        assert row["n_chars"] == len(plain[i])
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (x.split(" ") for x in (row["fingerprint"], row["edited_fingerprint"], got[following]["fingerprint"]))
        for near, other in ((row["near_edited"], b), (row["near_next"], c)):
            filled = [(x, y) for x, y in zip(a, other, strict=True) if (x, y) != ("-", "-")]
            assert near == (sum(x == y for x, y in filled) / len(filled) if filled else 1.0)
        assert (row["fingerprint"] == got[following]["fingerprint"]) == (words[i] == words[following])


def test_sketch_cells_are_spread_and_grow_with_the_texts(spark):
    h = np.random.default_rng(1).integers(0, 1 << 63, 60_000, dtype=np.uint64)
    for cells in substrings._cells(np.unique(substrings.window_keys(h, 50)), 16):
        assert abs((cells < 1 << 13).mean() - 1 / 8) < 0.02
    small, large = (spark.createDataFrame([("x" * n,)], "text STRING") for n in (100, 64_000_000))
    assert substrings.sketch_bits(small) == substrings.LEAST_BITS
    assert substrings.sketch_bits(large) == 23
    assert substrings.sketch_bits(small.limit(0)) == substrings.LEAST_BITS
