"""Packing token ids into fixed windows by multiway differencing.

Every document becomes the ids of its text followed by an end id. Whole windows
are cut from a document first; what is left of each document is gathered, within
one task, into groups that fill a fixed number of windows, and each group is
shared out by Karmarkar-Karp differencing: the two partial partitions with the
largest imbalance are merged so that the fullest windows of one meet the emptiest
of the other. If a window would hold more than its capacity, the group gets one
window more. The last group of a task keeps whole windows too: its tail is cut
at powers of two, which need no padding.

Nothing is shuffled. A task holds one group of ids at a time, and pieces go to Spark
in batches bounded by their bytes.

Defined results: a null or empty text is the end id alone; a null or repeated
document id is carried as it is, each row being packed on its own; an empty table
gives no piece; further columns of the input are not read.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import bound_batches

PIECE_SCHEMA = (
    "doc_id LONG, start LONG, length LONG, ids BINARY, doc_tokens LONG, sequence_id LONG, offset LONG"
)

#: Words whose ids a worker remembers, older ones included; each takes about 160 bytes.
CACHED_WORDS = 300_000
#: Bytes of pieces from which a batch goes to Spark.
PIECE_BYTES = 1 << 20

_TAIL = re.compile(r"^(.+?)([.,;:!?]+)$", re.DOTALL)


class _WordIds(dict):
    """Ids of a text without blanks or line breaks, as little-endian 32-bit bytes.

    The tokenizer splits at white space before it merges, and its normalisation
    does not look across a blank, so a text's ids are those of its words in turn.
    """

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # How the tokenizer writes each byte of a letter.
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        self.letters = {ord(c): shown.pre_tokenize_str(c)[0][0] for c in letters}
        #: What was here before the last time this was full; words in use come back from it.
        self.older: dict[str, bytes] = {}
        self[""] = b""

    def _encode(self, word: str) -> bytes:
        if word.isalpha() and max(word) <= "\xff":
            # One pre-token, already composed: only the merging is left to do.
            ids = [t.id for t in self.tokenizer.model.tokenize(word.lower().translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stays_letters(self, word: str) -> bool:
        return max(word) <= "\xff" or self.tokenizer.normalizer.normalize_str(word).isalpha()

    def _find(self, word: str) -> bytes:
        # Letters and closing marks are split by the tokenizer, so they are kept apart. Some letters
        # are taken apart by its normalisation and end in a mark, which goes with those that follow.
        parts = _TAIL.match(word)
        if parts and parts[1].isalpha() and self._stays_letters(parts[1]):
            return self[parts[1]] + self[parts[2]]
        if word.isascii() and word != word.lower() and "<|" not in word:
            return self[word.lower()]
        return self._encode(word)

    def __missing__(self, word: str) -> bytes:
        found = self.older.pop(word, None)
        if found is None:
            found = self._find(word)
        if len(self) >= CACHED_WORDS // 2:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        self[word] = found
        return found


_LOADED: dict[str, _WordIds] = {}


def _word_ids(tokenizer_file: str) -> _WordIds:
    if tokenizer_file not in _LOADED:
        _LOADED[tokenizer_file] = _WordIds(tokenizer_file)
    return _LOADED[tokenizer_file]


def encode_text(text: str | None, words: _WordIds, end_id: int) -> bytes:
    """The text's ids and the end id as little-endian 32-bit bytes."""
    chunks = (text or "").replace("\n", " ").split(" ")
    return b"".join(map(words.__getitem__, chunks)) + end_id.to_bytes(4, "little")


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Share items out to windows of near-equal sums; gives the items of each window.

    A partial partition is a list of (sum, items), the fullest first, without its
    empty windows. Its imbalance is the fullest sum less the emptiest.
    """
    heap = [(-n, i, [(n, (i,))]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    order = len(lengths)
    while len(heap) > 1:
        _, _, full = heapq.heappop(heap)
        _, _, other = heapq.heappop(heap)
        over = len(full) + len(other) - windows
        if over <= 0:
            merged = full + other
        else:
            # The emptiest of the first take the fullest of the second, the other way round at the end.
            keep, fill = len(full) - over, len(other) - over
            merged = full[:keep] + other[:fill]
            for (a, x), (b, y) in zip(full[keep:], reversed(other[fill:]), strict=True):
                merged.append((a + b, (x, y)))
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[0][0], order, merged))
        order += 1
    return [_leaves(items) for _, items in heap[0][2]] if heap else []


def _leaves(items: tuple) -> list[int]:
    found, todo = [], [items]
    while todo:
        item = todo.pop()
        if isinstance(item, tuple):
            todo.extend(item)
        else:
            found.append(item)
    return found


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most the capacity: as few as fit, one more whenever one overflows."""
    windows = -(-sum(lengths) // capacity)
    while True:
        shared = difference(lengths, windows)
        if all(sum(lengths[i] for i in own) <= capacity for own in shared):
            return shared
        windows += 1


def powers_of_two(total: int) -> list[int]:
    return [1 << bit for bit in range(total.bit_length() - 1, -1, -1) if total >> bit & 1]


class _Packer:
    """Turns documents into rows of pieces; holds the ids of one group."""

    def __init__(self, capacity: int, windows: int, slack: int, piece: int, first_sequence: int) -> None:
        self.capacity = capacity
        self.piece = piece
        self.room = windows * (capacity - slack)
        self.slack = slack
        self.sequence = first_sequence
        self.pending: list[tuple] = []  # (doc_id, start, ids, tokens of the document)
        self.held = 0

    def _emit(self, windows: list[list[tuple]]) -> Iterator[tuple]:
        for pieces in windows:
            at = 0
            for doc_id, start, ids, total in pieces:
                n = len(ids) // 4
                yield doc_id, start, n, ids, total, self.sequence, at
                at += n
            self.sequence += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total, start, cap = len(ids) // 4, 0, self.capacity
        while total - start >= cap:
            yield from self._emit([[(doc_id, start, ids[4 * start : 4 * (start + cap)], total)]])
            start += cap
        while start < total:
            take = min(total - start, self.piece, self.room - self.held)
            self.pending.append((doc_id, start, ids[4 * start : 4 * (start + take)], total))
            self.held += take
            start += take
            if self.held == self.room:
                yield from self._share(self.pending)
                self.pending, self.held = [], 0

    def _share(self, pieces: list[tuple]) -> Iterator[tuple]:
        shared = pack_lengths([len(p[2]) // 4 for p in pieces], self.capacity)
        yield from self._emit([[pieces[i] for i in own] for own in shared])

    def close(self) -> Iterator[tuple]:
        """Whole windows for the rest, and its tail cut at powers of two."""
        whole = self.held // self.capacity * (self.capacity - self.slack)
        tail = powers_of_two(self.held - whole)
        head: list[tuple] = []
        windows: list[list[tuple]] = []
        room = whole
        for doc_id, start, ids, total in self.pending:
            at, n = 0, len(ids) // 4
            while at < n:
                if not room:
                    windows.append([])
                    room = tail[len(windows) - 1]
                take = min(room, n - at)
                piece = (doc_id, start + at, ids[4 * at : 4 * (at + take)], total)
                (windows[-1] if windows else head).append(piece)
                room -= take
                at += take
        if head:
            yield from self._share(head)
        yield from self._emit(windows)


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    *,
    end_id: int = 2,
    capacity: int = 4096,
    windows: int = 32,
    slack: int = 24,
    piece: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most `capacity` ids.

    `windows` windows are shared out together, `slack` ids of each left open for the
    imbalance, which is small because what is shared out has at most `piece` ids.
    `ids` holds the piece's ids as little-endian 32-bit integers.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        words = _word_ids(tokenizer_file)
        # A partition's sequences follow each other from its own first id.
        packer = _Packer(capacity, windows, slack, piece, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from packer.add(doc_id, encode_text(text.as_py(), words, end_id))
        yield from packer.close()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in pieces(batches):
            rows.append(row)
            held += len(row[3]) + 48  # the numbers beside the ids
            if held >= PIECE_BYTES:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)

    bound_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(pack, PIECE_SCHEMA)
