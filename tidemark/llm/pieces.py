"""SentencePiece merge-type encoding by backtracking, and decoding.

A text is encoded piece by piece, longest match first. Aho-Corasick gives the
longest piece from every position. A piece may follow another only if merging
their joined characters anew gives just these two pieces; if it does not, the next
shorter piece is tried, and if none is left the previous piece is taken back and
its position marked in a bitfield as a dead end. A sequence whose neighbours are all
compatible is the one that merging yields, so the result is the library's.

No piece joins certain characters (a letter and a blank after it, a letter and a
full stop), so texts are cut between them first and each part is encoded alone;
parts recur, and a worker remembers a bounded number of them.

Defined results: a null or empty text has the end id alone and decodes to an
empty text; document ids are carried as they are, null or repeated; an empty
table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"

#: Parts whose ids a worker remembers; each entry takes about 250 bytes.
CACHED_PARTS = 450_000
#: Documents of one output batch.
ROWS_OUT = 500

_RUNS = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")


class PieceModel(dict):
    """Vocabulary and encoder; as a dict, the ids of parts as native 32-bit bytes."""

    def __init__(self, model_file: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.end = model.eos_id()
        self.bytes_from: dict[int, int] = {}
        self.texts: list[bytes] = [b""] * size
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes_from[value] = i
                self.texts[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
                self.texts[i] = piece.replace(BLANK, " ").encode()
        self.joined = {pair for piece in self.ids for pair in zip(piece, piece[1:], strict=False)}
        self.plain_breaks = not any(a == "\n" or b == "\n" or (b == BLANK and a != BLANK) for a, b in self.joined)
        self.matches = ahocorasick.Automaton()
        for piece in self.ids:
            self.matches.add_word(piece, piece)
        self.matches.make_automaton()
        self.shorter = {p: self._longest_prefix(p) for p in self.ids}
        self.compatible: dict[tuple[str, str], bool] = {}

    def _longest_prefix(self, piece: str) -> str | None:
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), None)

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored neighbours first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        todo: list[tuple[float, int, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(parts):
                both = parts[left] + parts[right]
                if both in self.score:
                    heapq.heappush(todo, (-self.score[both], left, right, both))

        for left in range(len(parts) - 1):
            offer(left)
        while todo:
            _, left, right, both = heapq.heappop(todo)
            if parts[left] is None or parts[right] is None or parts[left] + parts[right] != both or after[left] != right:
                continue
            parts[left], parts[right] = both, None
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [p for p in parts if p is not None]

    def _fits(self, first: str, second: str) -> bool:
        pair = (first, second)
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= CACHED_PARTS:
                self.compatible.clear()
            known = self.compatible[pair] = self.merge(first + second) == [first, second]
        return known

    def _backtrack(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are pieces."""
        size = len(text)
        longest: list[str] = list(text)
        for last, piece in self.matches.iter(text):
            first = last + 1 - len(piece)
            if len(piece) > len(longest[first]):
                longest[first] = piece
        dead = 0
        at, taken, piece = 0, [], longest[0]
        while at < size:
            while piece is not None and (dead >> (at + len(piece)) & 1 or (taken and not self._fits(taken[-1], piece))):
                piece = self.shorter[piece]
            if piece is not None:
                taken.append(piece)
                at += len(piece)
                piece = longest[at] if at < size else None
            elif taken:
                dead |= 1 << at
                piece = taken.pop()
                at -= len(piece)
                piece = self.shorter[piece]
            else:
                raise ValueError(f"no sequence of compatible pieces: {text[:80]!r}")
        return taken

    def _part(self, text: str) -> list[int]:
        if len(text) == 1 and text not in self.ids:
            return [self.bytes_from[b] for b in text.encode()]
        return [self.ids[p] for p in self._backtrack(text)]

    def __missing__(self, text: str) -> bytes:
        joined = self.joined
        cuts = [at for at, pair in enumerate(zip(text, text[1:], strict=False), 1) if pair not in joined]
        if cuts:
            found = b"".join([self[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])
        else:
            ids = self._part(text) if text else []
            found = struct.pack(f"={len(ids)}i", *ids)
        if len(self) >= CACHED_PARTS:
            self.clear()
        self[text] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a text and the end id as native 32-bit bytes."""
        end = np.int32(self.end).tobytes()
        if not text:
            return end
        shown = BLANK + text.replace(" ", BLANK)
        if not self.plain_breaks:
            parts = [shown]
        elif BLANK * 2 in shown or "\x1e" in shown:
            parts = _RUNS.findall(shown)
        else:
            parts = shown.replace(BLANK, "\x1e" + BLANK).replace("\n", "\x1e\n\x1e").split("\x1e")
        return b"".join(map(self.__getitem__, parts)) + end

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: blanks restored, the first one dropped, control ids silent."""
        raw = b"".join(map(self.texts.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_LOADED: dict[str, PieceModel] = {}


def piece_model(model_file: str) -> PieceModel:
    if model_file not in _LOADED:
        _LOADED[model_file] = PieceModel(model_file)
    return _LOADED[model_file]


def encode_documents(
    docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids): the ids of each whole text with the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                ids = [model.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.record_batch([part.column(0), lists], ["doc_id", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(encode, "doc_id LONG, ids ARRAY<INT>")


def decode_documents(encoded: DataFrame, model_file: str, *, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of the ids; null ids give an empty text.

    An input column of that name is replaced.
    """

    def decode(lists: pa.Array) -> pa.Array:
        model = piece_model(model_file)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], dtype=np.int64)
        ends = np.cumsum(sizes)
        return pa.array(
            [model.decode(flat[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.string()
        )

    as_column = F.arrow_udf(decode, "string")
    return encoded.withColumn("decoded", as_column(F.col(ids_col)))
