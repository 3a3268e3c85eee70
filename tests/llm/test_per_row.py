"""Operators that treat each row alone: pages, pieces, packing, rules, toxicity, scoring."""

from __future__ import annotations

import math
import time
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import folds, lattice, mincut, packing, pieces, rules, toxicity

BPE = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = r"[^\x20\x09-\x0D]+"


def by_text(rows, *names):
    return Counter((r["doc_id"], *(r[n] for n in names)) for r in rows)


PAGE = """<!DOCTYPE html><html><head><title>Site title</title><style>p{}</style><script>var a="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></ul></nav>
<!-- hidden --><div class="ad">Buy these things now, they are cheap.</div><div id="cookie-notice">We use cookies here.</div>
<article><h1>The title</h1><p><b>First &amp; best.<br><p>Second   one with <a href="x">a link</a> inside
it.</p><p>Short.</p></article><section class="comments"><p>I liked this very much, thanks for writing.</p></section>
<aside>Other stories that you may like to read.</aside><form><label>Your mail address</label></form>
<footer>&copy; site, all rights reserved.</footer></body></html>"""


def test_main_text_leaves_everything_else_out():
    assert mincut.main_text(PAGE) == "The title\nFirst & best.\nSecond one with a link inside it.\nShort."


def test_pages_null_empty_and_broken(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "u", ""), (3, "u", PAGE[:700]), (4, "u", "<" * 50)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").withColumn("text", F.lit(1))
    got = mincut.extract_pages(pages).collect()
    assert len(got) == 6
    assert Counter(r["text"] for r in got)[mincut.main_text(PAGE)] >= 2
    assert [r["text"] for r in got if r["page_id"] is None] == [""]
    assert mincut.extract_pages(pages.limit(0)).collect() == []


def test_cut_is_minimal_against_all_labellings():
    draw = np.random.default_rng(3)
    for _ in range(30):
        n = int(draw.integers(1, 8))
        costs = draw.normal(0, 2, n).tolist()
        edges = [(i, j, float(draw.random())) for i in range(n) for j in range(i + 1, n) if draw.random() < 0.5]

        def total(labels, costs=costs, edges=edges):
            own = sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(costs, labels, strict=True))
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(total([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert math.isclose(total(mincut.source_side(costs, edges)), best, abs_tol=1e-9)


def test_pieces_equal_the_library(documents, empty, texts):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    got = pieces.decode_documents(pieces.encode_documents(documents, MODEL), MODEL).collect()
    want = Counter()
    for i, t in texts:
        ids = [*library.encode(t or ""), library.eos_id()]
        want[(i, tuple(ids), library.decode(ids))] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    assert pieces.encode_documents(empty, MODEL).collect() == []


def test_backtracking_equals_merging_on_mixed_pieces():
    import random

    from sentencepiece import SentencePieceProcessor

    library, model, draw = SentencePieceProcessor(model_file=MODEL), pieces.piece_model(MODEL), random.Random(5)
    names = list(model.ids)
    for _ in range(1500):
        text = "".join(draw.choice(names) for _ in range(8))
        assert np.frombuffer(model.encode(text), np.int32).tolist()[:-1] == library.encode(text)


def test_packing_holds_every_id_once(documents, empty, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    got = packing.pack_documents(documents.coalesce(1), BPE, capacity=256, windows=4, piece=64, slack=8).collect()
    sequences = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 256
    whole = Counter()
    for i, t in texts:
        whole[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert {i: n for i, n in whole.items()} == {
        i: sum(r["length"] for r in got if r["doc_id"] == i) for i in whole
    }
    long = dict(texts)[60]
    ids = [*tokenizer.encode(long, add_special_tokens=False).ids, 2]
    for r in got:
        if r["doc_id"] == 60:
            assert list(np.frombuffer(r["ids"], "<u4")) == ids[r["start"] : r["start"] + r["length"]]
    total = sum(whole.values())
    padding = sum(256 - n for n in (sum(n for _, n in p) for p in sequences.values()) if n & (n - 1))
    assert padding < 0.1 * total
    assert packing.pack_documents(empty, BPE).collect() == []


def test_differencing_is_near_equal_and_rises_when_full():
    lengths = [17, 5, 9, 9, 3, 11, 2, 8, 14, 6]
    shared = packing.difference(lengths, 4)
    assert sorted(i for own in shared for i in own) == list(range(len(lengths)))
    sums = [sum(lengths[i] for i in own) for own in shared]
    assert max(sums) - min(sums) <= 4
    assert len(packing.pack_lengths([6, 6, 6], 10)) == 3
    assert packing.powers_of_two(13) == [8, 4, 1]


def test_words_are_encoded_as_whole_texts_are():
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(BPE), packing._word_ids(BPE)
    for text in ["It's THEIRS, don't!!", "<|endoftext|> <|ENDOFTEXT|>y", "Ⅷ ﬁ İ ẞ T̈ ΣΑΣ", "a\x85b　c", ".a.b. ... ½"]:
        assert list(np.frombuffer(packing.encode_text(text, words, 2), "<u4")) == [
            *tokenizer.encode(text, add_special_tokens=False).ids,
            2,
        ]


def test_rule_measures_against_counting(documents, empty, texts):
    want = Counter()
    for i, t in texts:
        t = t or ""
        w = re.findall(WORD, t)
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        often = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if often[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        symbols = len(re.findall(r"[#*$%&|<>]", t))
        want[(i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed)] += 1
    got = rules.judge_documents(documents).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_text(got, *names) == want
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert {r["rejected_by"] for r in got if r["doc_id"] in (3, 5, 60)} == {"line_ends"}
    ended = documents.withColumn("text", F.concat("text", F.lit(".")))
    assert all(r["kept"] for r in rules.judge_documents(ended).collect() if r["doc_id"] in (3, 5, 60))
    assert rules.judge_documents(empty).collect() == []


def test_cascade_order_does_not_change_the_verdict(documents):
    own = rules.production_rules()
    one = rules.judge_documents(documents, own).select("doc_id", "kept").collect()
    two = rules.judge_documents(documents, own[::-1]).select("doc_id", "kept").collect()
    assert Counter(one) == Counter(two)


@pytest.fixture(scope="module")
def insults():
    from tests.llm.conftest import prose

    rows = []
    for i in range(400):
        words = prose(1000 + i, 40)
        if i % 4 == 0:
            words[5::13] = ["vilestuff" + s for s in prose(i, 3)]
        rows.append((i, " ".join(words[:40]), int(i % 4 == 0)))
    return rows


def test_toxicity_on_held_out_rows_and_unseen_forms(spark, insults):
    docs = spark.createDataFrame([(i, t) for i, t, _ in insults], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, y) for i, _, y in insults], "doc_id LONG, toxic INT")
    got = toxicity.toxicity(docs, labels, ~folds.held_out(4, 2)).withColumn("fold", folds.held_out(4, 2)).collect()
    truth = {i: y for i, _, y in insults}
    held = [r for r in got if r["fold"]]
    toxic = [r["score"] for r in held if truth[r["doc_id"]]]
    clean = [r["score"] for r in held if not truth[r["doc_id"]]]
    above = sum(a > b for a in toxic for b in clean)
    assert above >= 0.95 * len(toxic) * len(clean)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_odd_rows(documents, empty, spark):
    labels = spark.createDataFrame([(5, 1), (20, 0), (20, None), (None, 1), (999, 1)], "doc_id LONG, toxic INT")
    got = toxicity.toxicity(documents, labels, F.lit(True)).collect()
    assert len(got) == documents.count()
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.toxicity(documents, none, F.lit(True)).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels, F.lit(True)).collect() == []


def test_lattice_sums_all_segmentations():
    own = lattice.load_pieces(MODEL)
    logs = np.log(own.start)
    number = {n: i for i, n in enumerate(own.names)}

    def brute(text):
        total = [1.0] + [0.0] * len(text)
        for end in range(1, len(text) + 1):
            total[end] = sum(total[s] * math.exp(logs[number[text[s:end]]]) for s in range(end) if text[s:end] in number)
        return total[-1]

    words = [b"the", b"reading", b"antlion", b"a"]
    got = lattice.word_logs(words, own, logs[None])[0]
    for word, value in zip(words, got, strict=True):
        assert math.isclose(value, math.log(brute("▁" + word.decode())), rel_tol=1e-9)


def test_expected_counts_spell_the_words():
    own = lattice.load_pieces(MODEL)
    words = [b"reading", b"antlion", "naïve".encode(), "日x".encode()]
    counts = lattice.expected_counts(words, own, np.log(own.start))
    spelled = sum(n * len(name) for n, name in zip(counts, own.names, strict=True))
    known = sum(1 for w in words for c in "▁" + w.decode() if c in own.known)
    assert math.isclose(spelled, known, rel_tol=1e-6)


def test_scores_against_counting(documents, empty, texts):
    held = folds.held_out(5, 1)
    got = lattice.score_documents(documents, MODEL, held, class_col="lang").collect()
    import zlib

    tokens = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in texts]
    out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in tokens]
    counts = Counter()
    for (_, ws), h in zip(tokens, out, strict=True):
        if not h:
            counts.update(ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for (i, ws), h in zip(tokens, out, strict=True):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want[(i, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6))] += 1
    assert want == Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got
    )
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert lattice.score_documents(empty, MODEL, held).collect() == []
    untrained = lattice.score_documents(documents, MODEL, F.lit(True)).collect()
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in untrained)


def test_ids_around_every_letter_and_cut():
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(BPE), packing._word_ids(BPE)
    for code in range(0x21, 0x30000):
        char = chr(code)
        if not (char.isalpha() or char.lower() != char or code < 0x3000):
            continue
        for text in (f"{char}.", f"a{char}?!", f"{char}b, x"):
            got = np.frombuffer(packing.encode_text(text, words, 2), "<u4")[:-1].tolist()
            assert got == tokenizer.encode(text, add_special_tokens=False).ids, (hex(code), text)


ARTICLE = "<p>The quick brown fox jumps over the lazy dog, and the dog does not mind at all.</p>" * 6
ARTICLE_TEXT = "\n".join(["The quick brown fox jumps over the lazy dog, and the dog does not mind at all."] * 6)


@pytest.mark.parametrize(
    ("page", "more"),
    [
        (f'<div class="layout has-sidebar"><article>{ARTICLE}</article><div class="sidebar"><p>Other news.</p></div></div>', ""),
        (f'<body><article id="page-header-article">{ARTICLE}</article></body>', ""),
        (f'<article>{ARTICLE}<p class="share-price">A share rose by two percent today.</p></article>', "A share rose by two percent today."),
        (f'<article>{ARTICLE}<ul class="tags-list"><li>Its first point is this one.</li></ul></article>', "Its first point is this one."),
        (f'<article>{ARTICLE}<div class="share-buttons"><p>Share this story now.</p></div></article>', ""),
        (f'<form id="all"><div>{ARTICLE}</div><div class="comments"><p>I like it.</p></div></form>', ""),
        (f'<div class="nav"><div>{ARTICLE}</div></div><footer>All rights reserved.</footer>', ""),
        (f'<div>{ARTICLE}</div><div class="comment-list"><article class="comment"><p>I like it very much.</p></article></div>', ""),
        (f'<article>{ARTICLE}</article><section class="related"><article><p>Read this as well, please.</p></article></section>', ""),
    ],
)
def test_names_count_only_for_parts_of_the_page(page, more):
    assert mincut.main_text(page) == "\n".join(x for x in (ARTICLE_TEXT, more) if x)


@pytest.mark.parametrize("bad", ["<a ", '<a b=">"', "<div>", "<p a='", "<!--", "<svg>", "</p><div>", '<a "', "<script", "</script", "<"])
def test_broken_pages_take_time_in_proportion(bad):
    started = time.perf_counter()
    mincut.main_text(bad * (400_000 // len(bad)))
    assert time.perf_counter() - started < 10


def test_classes_are_counted_over_training_rows(spark):
    rows = [(i, f"c{i % 20}" if i < 400 else "held") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id LONG, lang STRING")
    number, classes = lattice._class_numbers(docs, F.col("doc_id") >= 400, "lang")
    got = docs.select("lang", number.alias("n")).distinct().collect()
    assert classes == 21 and len({r["n"] for r in got}) == 21
    assert [r["n"] for r in got if r["lang"] == "held"] == [20]
