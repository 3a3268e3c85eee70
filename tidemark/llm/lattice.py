"""Text probability by a subword lattice.

An existing vocabulary gives the pieces. A word may be read as any sequence of pieces
that spells it; each sequence weighs the product of its pieces' probabilities, and
the forward recursion, in logarithms, adds all of them up. The stored scores of a
merge-type vocabulary are ranks, so they start the probabilities as one over the rank,
and expectation steps over all distinct training words then fit them.

In a text's lattice each word is one stretch between two nodes, with two kinds of arcs:
the word as a whole, weighing (c - d) / N for c training occurrences among N, and the
piece sequences, which share the weight d * V / N that discounting has freed. A
word's pieces begin with a mark, so the sequences that spell words sum to one over
all words, and so do both kinds together. A text's probability is the product over
its words and its end, which counts as a word.

Training rows may carry a class, such as their language. Counts and piece probabilities
are then kept for each class of at least one in CLASS_PARTS training rows and for all
others together, a class's own counts being discounted in favour of all classes together
and of its pieces, and a text's probability is the sum over the classes it may be of. The class of a row that is scored is not read.

Words are counted and scored as a table; nothing of the corpus is held on the driver
but sums by piece and the words that make up at least one in HEAD_PARTS training tokens,
of which there can be at most HEAD_PARTS. Those are looked up in the tasks; all other
words of a document meet the table by a shuffle.

Defined results: a null or empty text is its end alone; a null id counts as training;
rows are scored on their own, equal ids or not; an empty table gives an empty result,
and without training rows pieces alone give the scores; further columns of the input
are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordhash
from tidemark.session import materialize

BLANK = "▁"
DISCOUNT = 0.75
#: Expectation steps over the training words.
ROUNDS = 2
#: A word at least this common is looked up in the tasks; also the most there can be.
HEAD_PARTS = 1 << 20
#: Of what a class's counts leave, the share that its pieces get before all classes' counts.
PIECE_SHARE = 0.8
#: A class with at least one in CLASS_PARTS training rows is counted apart, so there are at most CLASS_PARTS.
CLASS_PARTS = 64
#: Share of all pieces that spells characters outside the vocabulary, by bytes.
BYTE_SHARE = 1e-4
#: Added to each piece's expected count, so that none becomes impossible.
PRIOR = 0.1
#: Words counted in a task before they are passed on, and words of one lattice batch.
COUNTED_WORDS = 300_000
BATCH_WORDS = 8_192
END = b" "  # no word has a blank


class Pieces:
    """Vocabulary of a model file, found in words by Aho-Corasick."""

    def __init__(self, model_file: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.names: list[str] = []
        ranks = []
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            special = model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
            # A word has one mark, at its start.
            if not special and BLANK not in name[1:]:
                self.names.append(name)
                ranks.append(-model.get_score(i))
        start = 1.0 / (np.array(ranks) + 10.0)
        self.start = start / start.sum()
        self.finder = ahocorasick.Automaton()
        for i, name in enumerate(self.names):
            self.finder.add_word(name, (i, len(name)))
        self.finder.make_automaton()
        self.known = {name for name in self.names if len(name) == 1}


_LOADED: dict[str, Pieces] = {}


def load_pieces(model_file: str) -> Pieces:
    if model_file not in _LOADED:
        _LOADED[model_file] = Pieces(model_file)
    return _LOADED[model_file]


def _log_add(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Logarithm of the sums of exponentials over the stretches that begin at `first`."""
    top = np.maximum.reduceat(values, first)
    sizes = np.diff(np.append(first, len(values)))
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, sizes)), first))


class Lattices:
    """The lattices of a batch of words: nodes between characters, arcs that are pieces."""

    def __init__(self, words: list[bytes], pieces: Pieces) -> None:
        base = 0
        starts, ends, names, levels = [], [], [], []
        lone = math.log(BYTE_SHARE / 256)
        self.last, self.first = [], []
        odd: list[tuple[int, float]] = []
        for word in words:
            text = BLANK + word.decode("utf-8", "surrogatepass")
            for last, (name, size) in pieces.finder.iter(text):
                starts.append(base + last + 1 - size)
                ends.append(base + last + 1)
                names.append(name)
                levels.append(last + 1)
            if not pieces.known.issuperset(text):
                for at, char in enumerate(text):
                    if char not in pieces.known:
                        odd.append((len(names), lone * len(char.encode("utf-8", "surrogatepass"))))
                        starts.append(base + at)
                        ends.append(base + at + 1)
                        names.append(-1)
                        levels.append(at + 1)
            self.first.append(base)
            base += len(text) + 1
            self.last.append(base - 1)
        self.nodes = base
        self.starts, self.ends = np.array(starts, np.int64), np.array(ends, np.int64)
        self.names, self.levels = np.array(names, np.int64), np.array(levels, np.int64)
        self.odd = odd
        self.order = np.lexsort((self.ends, self.levels))

    def weights(self, logs: np.ndarray) -> np.ndarray:
        found = logs[self.names]
        for at, value in self.odd:
            found[at] = value
        return found

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Log weight of all paths from a word's first node to each node."""
        reach = np.full(self.nodes, -np.inf)
        reach[self.first] = 0.0
        order = self.order
        levels, ends, starts, own = self.levels[order], self.ends[order], self.starts[order], weights[order]
        cuts = np.flatnonzero(np.diff(levels)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(levels)], strict=True):
            first = np.concatenate([[0], np.flatnonzero(np.diff(ends[a:b])) + 1])
            reach[ends[a:b][first]] = _log_add(reach[starts[a:b]] + own[a:b], first)
        return reach

    def backward(self, weights: np.ndarray) -> np.ndarray:
        """Log weight of all paths from each node to its word's last node."""
        left = np.full(self.nodes, -np.inf)
        left[self.last] = 0.0
        begun = self.levels - (self.ends - self.starts)
        order = np.lexsort((self.starts, -begun))
        begun, starts, ends, own = begun[order], self.starts[order], self.ends[order], weights[order]
        cuts = np.flatnonzero(np.diff(begun)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(begun)], strict=True):
            first = np.concatenate([[0], np.flatnonzero(np.diff(starts[a:b])) + 1])
            left[starts[a:b][first]] = _log_add(left[ends[a:b]] + own[a:b], first)
        return left


def word_logs(words: list[bytes], pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability as pieces, a row for each row of `logs`."""
    found = np.empty((len(logs), len(words)))
    for at in range(0, len(words), BATCH_WORDS):
        part = Lattices(words[at : at + BATCH_WORDS], pieces)
        for kind, own in enumerate(logs):
            found[kind, at : at + BATCH_WORDS] = part.forward(part.weights(own))[part.last]
    return found


def expected_counts(words: list[bytes], pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, each taken once."""
    total = np.zeros(len(logs))
    for at in range(0, len(words), BATCH_WORDS):
        part = Lattices(words[at : at + BATCH_WORDS], pieces)
        weights = part.weights(logs)
        reach, left = part.forward(weights), part.backward(weights)
        whole = np.repeat(reach[part.last], np.array(part.last) - np.array(part.first) + 1)
        share = np.exp(reach[part.starts] + weights + left[part.ends] - whole[part.starts])
        named = part.names >= 0
        total += np.bincount(part.names[named], share[named], len(logs))
    return total


def count_words(rows: DataFrame, classes: int) -> DataFrame:
    """(word, c0, c1, ...): every word of (held_out, kind, text) and its training counts by class."""

    def table(kind: int, counts: Counter) -> pa.RecordBatch:
        return pa.record_batch(
            [
                pa.array(list(counts), pa.binary()),
                pa.array([kind] * len(counts), pa.int32()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["word", "kind", "c"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter() for _ in range(classes)]
        for batch in batches:
            columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
            for held_out, kind, text in zip(*columns, strict=True):
                found = wordhash.words(text.as_py(), lower=True)
                own = seen[kind]
                if held_out:
                    for word in set(found):
                        own.setdefault(word, 0)
                else:
                    own.update(found)
                    own[END] += 1
                if len(own) >= COUNTED_WORDS:
                    yield table(kind, own)
                    seen[kind] = Counter()
        for kind, own in enumerate(seen):
            if own:
                yield table(kind, own)

    parts = rows.select("held_out", "kind", "text").mapInArrow(count, "word BINARY, kind INT, c LONG")
    sums = [F.sum(F.when(F.col("kind") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
    return parts.groupBy("word").agg(*sums)


def fit_pieces(words: DataFrame, classes: int, model_file: str, rounds: int) -> np.ndarray:
    """Log probabilities of the pieces by class, after expectation steps over its distinct words."""
    pieces = load_pieces(model_file)
    logs = np.tile(np.log(pieces.start * (1 - BYTE_SHARE)), (classes, 1))
    counts = [f"c{k}" for k in range(classes)]
    trained = words.filter(F.greatest(F.lit(0), *counts) > 0).filter(F.col("word") != F.lit(END)).select("word", *counts)
    for _ in range(rounds):
        now = logs

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            own, total = load_pieces(model_file), np.zeros(now.shape)
            for batch in batches:
                found = batch.column(0).to_pylist()
                for kind in range(classes):
                    mine = np.flatnonzero(batch.column(kind + 1).to_numpy()).tolist()
                    total[kind] += expected_counts([found[i] for i in mine], own, now[kind])
            kinds, some = np.nonzero(total)
            yield pa.record_batch(
                [pa.array(kinds), pa.array(some), pa.array(total[kinds, some])], ["kind", "piece", "n"]
            )

        sums = trained.mapInArrow(expect, "kind LONG, piece LONG, n DOUBLE").groupBy("kind", "piece").agg(F.sum("n").alias("n"))
        found = np.full(logs.shape, PRIOR)
        for row in sums.collect():  # at most one row per class and piece of the vocabulary
            found[row["kind"], row["piece"]] += row["n"]
        logs = np.log(found / found.sum(axis=1, keepdims=True) * (1 - BYTE_SHARE))
    return logs


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct words and documents of each class, and words of all."""

    tokens: list[int]
    types: list[int]
    texts: list[int]
    all_types: int

    @property
    def all_tokens(self) -> int:
        return sum(self.tokens)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of words whose counts by class are the rows."""
        total = counts.sum(axis=0)
        return np.log10((total + 0.5) / (self.all_tokens + 0.5 * (self.all_types + 1)))

    def scores(self, counts: np.ndarray, piece_logs: np.ndarray) -> np.ndarray:
        """Natural log of the words' arcs together, by class."""
        found = piece_logs.copy()
        if not self.all_tokens:
            return found

        def whole(c: np.ndarray, n: int) -> np.ndarray:
            with np.errstate(divide="ignore"):
                return np.log(np.maximum(c - DISCOUNT, 0) / n)

        def freed(types: int, n: int) -> float:
            return math.log(DISCOUNT * types / n)

        shared = whole(counts.sum(axis=0), self.all_tokens)
        for kind, (n, types) in enumerate(zip(self.tokens, self.types, strict=True)):
            if not n:
                continue
            others = np.logaddexp(shared, freed(self.all_types, self.all_tokens) + piece_logs[kind])
            rest = np.logaddexp(math.log(PIECE_SHARE) + piece_logs[kind], math.log(1 - PIECE_SHARE) + others)
            found[kind] = np.logaddexp(whole(counts[kind], n), freed(types, n) + rest)
        return found


def _values(totals: Totals, counts: np.ndarray, piece_logs: np.ndarray) -> np.ndarray:
    return np.stack([totals.base(counts), *(totals.scores(counts, piece_logs) / math.log(10))])


def score_words(words: DataFrame, classes: int, model_file: str, logs: np.ndarray, totals: Totals) -> DataFrame:
    """(word, c, base, s0, s1, ...): count and log10 probabilities of each word, by class."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model_file)
        for batch in batches:
            # The end is read as the mark alone, which no word is.
            found = [b"" if w == END else w for w in batch.column(0).to_pylist()]
            counts = np.stack([batch.column(k + 1).to_numpy() for k in range(classes)])
            values = _values(totals, counts, word_logs(found, pieces, logs))
            yield pa.record_batch(
                [batch.column(0), pa.array(counts.sum(axis=0)), *map(pa.array, values)], names=["word", "c", *names]
            )

    names = _value_names(classes)
    schema = "word BINARY, c LONG, " + ", ".join(f"{n} DOUBLE" for n in names)
    return words.select("word", *(f"c{k}" for k in range(classes))).mapInArrow(score, schema)


def _value_names(classes: int) -> list[str]:
    return ["base", *(f"s{k}" for k in range(classes))]


def _score_common(rows: DataFrame, classes: int, head: dict[bytes, np.ndarray], end: np.ndarray) -> DataFrame:
    """Sums over each row's common words and its end, and the rest of its words.

    The values of a word: whether it is known, its base and its score in each class.
    """
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sums, sizes, rest, times, offsets = [], [], [], [], [0]
                for text in part.column(2):
                    found = wordhash.words(text.as_py(), lower=True)
                    values, weights = [end], [1]
                    for word, n in Counter(found).items():
                        own = common.get(word)
                        if own is None:
                            rest.append(word)
                            times.append(n)
                        else:
                            values.append(own)
                            weights.append(n)
                    sizes.append(len(found) + 1)
                    sums.append(np.array(weights) @ np.array(values))
                    offsets.append(len(rest))
                table = np.array(sums)
                lists = [
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, kind))
                    for x, kind in ((rest, pa.binary()), (times, pa.int64()))
                ]
                yield pa.record_batch(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(sizes, pa.int64()),
                        pa.array(table[:, 0].astype(np.int64)),
                        *(pa.array(column) for column in table[:, 1:].T),
                        *lists,
                    ],
                    names=["doc_id", "held_out", "n_tokens", "known", *names, "words", "times"],
                )

    names = _value_names(classes)
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        score,
        "doc_id LONG, held_out BOOLEAN, n_tokens LONG, known LONG, "
        + ", ".join(f"{n} DOUBLE" for n in names)
        + ", words ARRAY<BINARY>, times ARRAY<LONG>",
    )


def _class_numbers(docs: DataFrame, held_out: Column, class_col: str | None) -> tuple[Column, int]:
    """The class of a row as a number below the count of classes; the last holds all others.

    Classes are counted over training rows.
    """
    if class_col is None:
        return F.lit(0), 1
    label = F.col(class_col).cast("string")
    counts = docs.filter(~F.coalesce(held_out, F.lit(False))).groupBy(label.alias("label")).count()
    least = counts.agg((F.sum("count") / CLASS_PARTS).alias("n")).first()["n"] or 0
    common = counts.filter(F.col("label").isNotNull() & (F.col("count") >= least))
    common = [r["label"] for r in common.orderBy(F.desc("count"), "label").collect()]  # at most CLASS_PARTS
    number = F.lit(len(common))
    for i, name in enumerate(common):
        number = F.when(label == name, i).otherwise(number)
    return F.coalesce(number, F.lit(len(common))), len(common) + 1


def score_documents(
    docs: DataFrame,
    model_file: str,
    held_out: Column,
    *,
    class_col: str | None = None,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    `score` is the log10 probability of the text's lattice, `base_score` that of counted
    words with half a count added.
    """
    kind, classes = _class_numbers(docs, held_out, class_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        kind.cast("int").alias("kind"),
        F.col(text_col).cast("string").alias("text"),
    )
    words = materialize(count_words(rows, classes), "lattice-counts")
    counts = [f"c{k}" for k in range(classes)]
    is_end = F.col("word") == F.lit(END)
    sums = words.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in counts),
        *(F.count_if(F.col(c) > 0).alias(f"v_{c}") for c in counts),
        *(F.coalesce(F.max(F.when(is_end, F.col(c))), F.lit(0)).alias(f"e_{c}") for c in counts),
        F.count_if(F.greatest(F.lit(0), *counts) > 0).alias("v"),
    ).first()
    totals = Totals(*([sums[f"{x}_{c}"] for c in counts] for x in "nve"), sums["v"])
    logs = fit_pieces(words, classes, model_file, rounds)
    scored = materialize(score_words(words, classes, model_file, logs, totals), "lattice-words")

    names = _value_names(classes)
    frequent = scored.filter((F.col("c") > 0) & (F.col("c") * HEAD_PARTS >= totals.all_tokens) & ~is_end)
    # At most HEAD_PARTS rows, since their counts add up to no more than all tokens.
    head = {bytes(r["word"]): np.array([1.0, *(r[n] for n in names)]) for r in frequent.collect()}
    ends = np.array(totals.texts)[:, None]
    end = np.concatenate(
        [[float(ends.sum() > 0)], _values(totals, ends, word_logs([b""], load_pieces(model_file), logs))[:, 0]]
    )
    common = _score_common(rows, classes, head, end).withColumn("row", F.monotonically_increasing_id())
    common = materialize(common, "lattice-common")
    rest = common.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.times").alias("n")
    )
    more = (
        rest.join(scored, "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
            *(F.sum(F.col("n") * F.col(x)).alias(f"more_{x}") for x in names),
        )
    )
    joined = common.drop("words", "times").join(more, "row", "left")

    def whole(name: str) -> Column:
        return F.col(name) + F.coalesce(F.col(f"more_{name}"), F.lit(0))

    # The classes' shares of the training texts, even ones where there are none.
    texts = sum(totals.texts)
    shares = [(math.log10(n / texts) if texts else -math.log10(classes), k) for k, n in enumerate(totals.texts) if n or not texts]
    each = F.array(*(whole(f"s{k}") + F.lit(share) for share, k in shares))
    top = F.array_max("each")
    total = F.aggregate("each", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x - top))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        whole("known").alias("n_known"),
        F.lit(totals.all_tokens).cast("long").alias("train_tokens"),
        whole("base").alias("base_score"),
        each.alias("each"),
    ).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (top + F.log10(total)).alias("score")
    )
