"""Removal of word windows that an earlier document also has.

First pass: every partition counts its windows in a count-min sketch of two rows, and
the sparse partition sketches are merged by adding. A window is counted under the
smallest hash of the short word runs inside it, which equal windows share and which
neighbouring windows mostly share too, so a document adds few keys, each once; the
estimate of a window is never below the number of documents that have it. Second
pass: only windows estimated to be in two documents or more are grouped, exactly, by
a 96-bit hash of their words. The cells that hold two or more reach the tasks as two
bitmaps. Their size follows from the counted bytes of the texts, up to a documented most;
beyond that they fill up, more windows are grouped, and none is lost.

Documents with equal words are grouped before their windows are: those after the first
lose all words that a window covers, which is all of them.

Defined results: a null text counts as empty; texts shorter than a window stay; a null
id is not smaller or larger than any other, so such a row neither loses words nor
makes others lose theirs; rows of equal ids do not cut each other; an empty table gives
an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import carry, wordhash
from tidemark.session import bound_batches, materialize

WINDOW_WORDS = 50
#: Words of the runs whose smallest hash is a window's key.
RUN_WORDS = 24
#: Least and most of log2 of the cells in each of the sketch's two rows; the bitmaps take 2^(bits - 2)
#: bytes, so at most 128 MB at the driver and in every worker.
LEAST_BITS, MOST_BITS = 20, 29
#: Bytes of text for one key, about: 14 windows of six-byte words share one. Cells for each key.
BYTES_PER_KEY, CELLS_PER_KEY = 84, 8
#: Cells of one of Spark's bitmaps, which have 4096 bytes.
_SEGMENT_BITS = 15

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def window_keys(h: np.ndarray, window: int, run: int = RUN_WORDS) -> np.ndarray:
    """For each window of words the smallest hash of the runs in it."""
    if len(h) < window:
        return np.empty(0, np.uint64)
    run = min(run, window)
    low, width, want = wordhash.runs(h, run), 1, window - run + 1
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = want - width
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window of words."""
    found = []
    for salt in (1, 2):
        power, width, total, at = wordhash.mix(h + np.uint64(salt)), 1, None, 0
        size = len(h) - window + 1
        while width <= window:
            if window & width:
                part = power[at : at + size]
                total = part if total is None else wordhash.mix(total * np.uint64(0x9E3779B97F4A7C15) + part)
                at += width
            power = wordhash.mix(power[:-width] * np.uint64(0xD6E8FEB86659FD93) + power[width:])
            width *= 2
        found.append(total.view(np.int64))
    return found[0], found[1]


def _cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    # Keys are smallest hashes, so their high bits are mostly zero until mixed anew.
    mask = np.uint64((1 << bits) - 1)
    return (keys & mask).astype(np.int64), (wordhash.mix(keys) >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(docs: DataFrame) -> int:
    """Width of the sketch for the texts of a table, from their counted bytes."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    cells = CELLS_PER_KEY * size // BYTES_PER_KEY
    return min(max(int(cells).bit_length(), LEAST_BITS), MOST_BITS)


def sketch(docs: DataFrame, *, window: int, bits: int) -> DataFrame:
    """(cell, n): the merged sketch, cells of the second row after those of the first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.empty(0, np.uint64)]
            for text in batch.column(0):
                keys.append(np.unique(window_keys(wordhash.hashes(wordhash.words(text.as_py())), window)))
            first, second = _cells(np.concatenate(keys), bits)
            cells, n = np.unique(np.concatenate([first, second + (1 << bits)]), return_counts=True)
            yield pa.record_batch([pa.array(cells), pa.array(n)], ["cell", "n"])

    parts = docs.select("text").mapInArrow(count, "cell LONG, n LONG")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"))


def repeated_cells(merged: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the cells with two or more, the lowest bit of a byte first.

    Its size is fixed by `bits`.
    """
    segment = F.shiftrightunsigned("cell", _SEGMENT_BITS).alias("segment")
    low = F.col("cell").bitwiseAND(F.lit((1 << _SEGMENT_BITS) - 1))
    pieces = merged.filter("n > 1").groupBy(segment).agg(F.bitmap_construct_agg(low).alias("bits"))
    size = 1 << (_SEGMENT_BITS - 3)
    found = np.zeros((1 << (bits + 1)) // 8, np.uint8)
    for piece in pieces.collect():
        at = piece["segment"] * size
        found[at : at + size] = np.frombuffer(piece["bits"], np.uint8)
    return found


def _set(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)


def mark_candidates(docs: DataFrame, bitmap: np.ndarray, *, window: int, bits: int) -> DataFrame:
    """(doc_id, text, n_words, words_key, starts, carried) of every row.

    `starts` has a bit for each window estimated repeated, `words_key` names the words;
    both are null in a document without such a window.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = shared.value
        for batch in batches:
            sizes, names, starts = [], [], []
            for text in batch.column(1):
                found = wordhash.words(text.as_py())
                sizes.append(len(found))
                first, second = _cells(window_keys(wordhash.hashes(found), window), bits)
                often = _set(repeated, first) & _set(repeated, second + (1 << bits))
                if often.any():
                    names.append(hashlib.blake2b(b" ".join(found), digest_size=16).digest())
                    starts.append(np.packbits(often).tobytes())
                else:
                    names.append(None)
                    starts.append(None)
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array(starts, pa.binary()),
                    batch.column(2),
                ],
                ["doc_id", "text", "n_words", "words_key", "starts", carry.CARRIED],
            )

    schema = "doc_id LONG, text STRING, n_words LONG, words_key BINARY, starts BINARY"
    return docs.mapInArrow(mark, carry.with_carried(schema, docs))


def candidate_windows(rows: DataFrame, window: int) -> DataFrame:
    """(high, low, doc_id, row, at) of every marked window of the rows that are no copies.

    All columns of `rows` go in, so that its exchange serves this and the cutting alike.
    """
    places = {name: rows.columns.index(name) for name in ("doc_id", "row", "text", "starts", "copy")}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(place) for name, place in places.items()}
            for i in range(batch.num_rows):
                doc_id = columns["doc_id"][i].as_py()
                if doc_id is None or columns["copy"][i].as_py():
                    continue
                at = np.flatnonzero(np.unpackbits(np.frombuffer(columns["starts"][i].as_py(), np.uint8)))
                high, low = window_hashes(wordhash.hashes(wordhash.words(columns["text"][i].as_py())), window)
                yield pa.record_batch(
                    [
                        pa.array(high[at]),
                        pa.array((low[at] >> 32).astype(np.int32)),
                        pa.array(np.full(len(at), doc_id, np.int64)),
                        pa.array(np.full(len(at), columns["row"][i].as_py(), np.int64)),
                        pa.array(at.astype(np.int32)),
                    ],
                    ["high", "low", "doc_id", "row", "at"],
                )

    return rows.mapInArrow(emit, "high LONG, low INT, doc_id LONG, row LONG, at INT")


def cut_words(text: str, gone: np.ndarray) -> str:
    """The text without the marked words, each cut with the separators before it."""
    raw = text.encode("utf-8", "surrogatepass")
    parts, kept_to = [], 0
    for i, word in enumerate(_WORD.finditer(raw)):
        if not gone[i]:
            parts.append(raw[kept_to : word.end()])
        kept_to = word.end()
    parts.append(raw[kept_to:])
    return b"".join(parts).decode("utf-8", "surrogatepass")


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, n_removed, text, carried) from (doc_id, text, n_words, copy, cuts, carried)."""
    places = {name: i for i, name in enumerate(rows.columns)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, texts = [], []
            inputs = (batch.column(places[name]).to_pylist() for name in ("text", "n_words", "copy", "cuts"))
            for text, n, copy, cuts in zip(*inputs, strict=True):
                # A window's start adds one, its end takes it away again.
                steps = np.zeros(n + 1, np.int64)
                if copy:
                    steps[0] = 1
                elif cuts:
                    at = np.array(cuts)
                    steps[at] += 1
                    np.subtract.at(steps, at + window, 1)
                gone = np.cumsum(steps[:n]) > 0
                removed.append(int(gone.sum()))
                texts.append(cut_words(text, gone) if removed[-1] else text)
            yield pa.record_batch(
                [
                    batch.column(places["doc_id"]),
                    batch.column(places["n_words"]),
                    pa.array(removed, pa.int64()),
                    pa.array(texts, pa.string()),
                    batch.column(places[carry.CARRIED]),
                ],
                ["doc_id", "n_words", "n_removed", "text", carry.CARRIED],
            )

    return rows.mapInArrow(cut, carry.with_carried("doc_id LONG, n_words LONG, n_removed LONG, text STRING", rows))


def remove_repeats(
    docs: DataFrame,
    *,
    window: int = WINDOW_WORDS,
    bits: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_removed, text, carried): every row without the words of earlier windows.

    A row that loses nothing keeps its text as it is, null included. `carried` holds the
    columns `keep`. `bits` sets the width of the sketch, else it follows from the texts.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        carry.packed(docs, keep or []),
    )
    bits = sketch_bits(docs) if bits is None else bits
    bitmap = repeated_cells(sketch(docs, window=window, bits=bits), bits)
    marked = mark_candidates(docs, bitmap, window=window, bits=bits)
    # Marked twice: most texts have no candidate, and storing them would cost more.
    plain = marked.filter("starts IS NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "text", carry.CARRIED
    )
    some = marked.filter("starts IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    some = materialize(some, "windows-marked")

    names = some.select("row", "doc_id", "words_key")
    firsts = names.groupBy("words_key").agg(F.min("doc_id").alias("first_id"))
    copies = names.join(firsts, "words_key").select(
        "row", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("copy")
    )
    # Texts are dealt by row once, for hashing their windows and for cutting them.
    some = some.drop("words_key").join(copies, "row")
    windows = candidate_windows(some, window)
    earliest = windows.groupBy("high", "low").agg(F.min("doc_id").alias("first"))
    later = windows.join(earliest, ["high", "low"]).filter("doc_id > first")
    # A row's list is bounded by its own words.
    cuts = later.groupBy("row").agg(F.collect_list("at").alias("cuts"))
    return plain.unionByName(_cut(some.join(cuts, "row", "left"), window))
