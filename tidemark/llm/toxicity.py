"""Toxicity by subword-bag embeddings and a linear softmax.

A word is the mean of the vectors of its character n-grams, a document the mean of its
words, and a linear softmax over that mean gives the two labels. Vectors and softmax are
trained together in numpy on a bounded sample of labelled rows; n-grams share hashed
rows of one table, so a misspelling never seen still has the vectors of its parts. As
everything before the softmax is a mean, a trained model comes down to one number per
n-gram, and a document's score to a mean over its words; tasks keep a bounded number of
words' values.

The score reads the text alone. Defined results: a null or empty text, or one without
words, scores as the bias alone does; document ids are carried as they are, null or
repeated; without labelled rows every score is 0, with one label every score is that
label; labels of null rows are not learned from; an empty table gives an empty result;
further columns of the input are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import carry, wordhash
from tidemark.session import bound_batches

#: Labelled rows that the model is fitted on, and the longest text among them: the
#: sample is collected, so both bound it.
SAMPLE_ROWS = 7_000
SAMPLE_CHARS = 12_000
NGRAMS = (3, 4, 5, 6)
BUCKET_BITS = 18
WIDTH = 4
#: An n-gram in fewer rows of the sample has no vector.
MIN_ROWS = 5
EPOCHS = 15
BATCH_ROWS = 256
STEP = 0.3
DECAY = 3e-5
#: A document's mean is small, since most words say nothing; the softmax sees it enlarged.
GAIN = 30.0
#: Share of predicted toxicity from which a document counts as toxic.
THRESHOLD = 0.3
#: Log odds from which a score is 0 or 1.
CERTAIN = 500.0
#: Words whose values a worker remembers.
CACHED_WORDS = 400_000


def ngram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, marked at both ends, and how many each word has."""
    text = "".join(f"<{w.decode('utf-8', 'replace')}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w.decode("utf-8", "replace")) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters up to the word's end
    mixed = wordhash.mix(codes + np.uint64(1))
    found, owners = [], []
    for n in NGRAMS:
        if len(codes) < n:
            continue
        fits = np.flatnonzero(left[: len(codes) - n + 1] >= n)
        total = np.full(len(fits), np.uint64(n))
        for i in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + mixed[fits + i]
        found.append((wordhash.mix(total) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        owners.append(owner[fits])
    buckets, owners_of = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners_of, kind="stable")
    return buckets[order], np.bincount(owners_of, minlength=len(words))


@dataclass(frozen=True)
class Model:
    """One number per n-gram bucket and a bias, in log odds of the mean over words."""

    values: np.ndarray
    bias: float

    def words(self, words: list[bytes]) -> np.ndarray:
        buckets, sizes = ngram_buckets(words)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(self.values[buckets], first) / sizes

    def odds(self, word_values: np.ndarray) -> float:
        return float(self.bias + (word_values.mean() if len(word_values) else 0.0))


def probability(odds: float) -> float:
    if abs(odds) >= CERTAIN:
        return float(odds > 0)
    return float(1 / (1 + np.exp(-odds)))


def _bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text as the buckets of its n-grams and their weights, laid end to end.

    A bucket's weight is its share in the mean over words of the means over n-grams.
    Buckets in fewer than MIN_ROWS texts are left out; the others are numbered anew.
    """
    index: dict[bytes, int] = {}
    rows = []
    for text in texts:
        found = wordhash.words(text, lower=True)
        ids = np.array([index.setdefault(w, len(index)) for w in found], np.int64)
        rows.append(tuple(part.astype(np.int32) for part in np.unique(ids, return_counts=True)))
    names = list(index)
    del index
    parts = [ngram_buckets(names[at : at + 20_000]) for at in range(0, len(names), 20_000)]
    spans = np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)]).astype(np.int64)
    grams = np.concatenate([np.empty(0, np.int32), *(p[0] for p in parts)])
    del names, parts
    begins = np.cumsum(spans) - spans

    def bag(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = spans[ids]
        at = np.repeat(begins[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        share = np.repeat(counts / (max(counts.sum(), 1) * n), n)
        buckets, place = np.unique(grams[at], return_inverse=True)
        return buckets, np.bincount(place, share, len(buckets)).astype(np.float32)

    # Built twice, so that no more is held than what is kept.
    seen = np.zeros(1 << BUCKET_BITS, np.int32)
    for ids, counts in rows:
        seen[bag(ids, counts)[0]] += 1
    kept = np.flatnonzero(seen >= MIN_ROWS)
    number = np.full(len(seen), -1, np.int32)
    number[kept] = np.arange(len(kept), dtype=np.int32)
    columns, weights, sizes = array("i"), array("f"), []
    for ids, counts in rows:
        buckets, share = bag(ids, counts)
        new = number[buckets]
        columns.frombytes(new[new >= 0].tobytes())
        weights.frombytes(share[new >= 0].tobytes())
        sizes.append(int((new >= 0).sum()))
    return kept, np.frombuffer(columns, np.int32), np.frombuffer(weights, np.float32), np.array(sizes, np.int64)


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Fit n-gram vectors and the softmax together by adaptive gradient steps."""
    y = np.array(labels, np.int64)
    values = np.zeros(1 << BUCKET_BITS, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(values, CERTAIN if len(y) and y[0] else -CERTAIN)
    kept, columns, weights, sizes = _bags(texts)
    ends = np.cumsum(sizes)
    draw = np.random.default_rng(seed)
    vectors = (draw.random((len(kept), WIDTH)) - 0.5) / WIDTH
    softmax = (draw.random((WIDTH, 2)) - 0.5) / WIDTH
    bias = np.log(np.bincount(y, minlength=2) / len(y))
    sums = [np.full_like(vectors, 1e-8), np.full_like(softmax, 1e-8), np.full_like(bias, 1e-8)]
    for epoch in range(EPOCHS):
        step = STEP * (1 - epoch / EPOCHS)
        order = draw.permutation(len(y))
        for first in range(0, len(order), BATCH_ROWS):
            batch = order[first : first + BATCH_ROWS]
            at = np.concatenate([np.arange(ends[i] - sizes[i], ends[i], dtype=np.int32) for i in batch])
            row = np.repeat(np.arange(len(batch), dtype=np.int32), sizes[batch])
            column, weight = columns[at], weights[at] * GAIN
            means = np.stack(
                [np.bincount(row, weight * vectors[column, j], len(batch)) for j in range(WIDTH)], axis=1
            )
            logits = means @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            back = p @ softmax.T
            grad = np.stack(
                [np.bincount(column, weight * back[row, j], len(kept)) for j in range(WIDTH)], axis=1
            )
            for value, own, total in zip(
                (vectors, softmax, bias), (grad + DECAY * vectors, means.T @ p, p.sum(axis=0)), sums, strict=True
            ):
                total += own * own
                value -= step * own / np.sqrt(total)
    values[kept] = GAIN * vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(values, float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> tuple[list, list]:
    """Texts and labels of at most `rows` labelled rows, in an order without meaning.

    `labels` has doc_id and label. The rows are drawn before the join, so the drawn side is small.
    """
    drawn = labels.filter(F.col("label").isNotNull() & learn).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    found = docs.join(F.broadcast(drawn), "doc_id").filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    got = found.select("doc_id", "text", "label").limit(rows).collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"] or "", r["label"]))
    return [r["text"] for r in got], [int(r["label"]) for r in got]


def score_texts(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, score, predicted, carried) of every row of (doc_id, text, carried)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known: dict[bytes, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [wordhash.words(t.as_py(), lower=True) for t in part.column(1)]
                new = list(set().union(*found).difference(known))
                if len(known) + len(new) > CACHED_WORDS:
                    known = {}
                    new = list(set().union(*found))
                for first in range(0, len(new), 20_000):
                    some = new[first : first + 20_000]
                    known.update(zip(some, own.words(some).tolist(), strict=True))
                scores = np.array(
                    [probability(own.odds(np.fromiter(map(known.__getitem__, w), float, len(w)))) for w in found]
                )
                yield pa.record_batch(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(scores),
                        pa.array((scores >= threshold).astype(np.int32)),
                        part.column(2),
                    ],
                    ["doc_id", "text", "score", "predicted", carry.CARRIED],
                )

    schema = carry.with_carried("doc_id LONG, text STRING, score DOUBLE, predicted INT", docs)
    return docs.select("doc_id", "text", carry.CARRIED).mapInArrow(score, schema)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    *,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    keep: list[str] | None = None,
) -> DataFrame:
    """(doc_id, text, score, predicted, carried) of every row; `carried` holds the columns `keep`.

    `learn` says which ids may be learned from.
    """
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        carry.packed(docs, keep or []),
    )
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return score_texts(docs, train(*labelled_sample(docs, marked, learn)), threshold)
