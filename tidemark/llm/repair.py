"""Repair of conversations by Hirschberg's divide and conquer.

A row of a conversation is kept, given another role or deleted, and empty turns may be
inserted, so that the roles follow `(s?(ua)+)?` at the least cost. Four states say what
the repaired rows end in: nothing, s, u or a. The rows before the middle of a conversation
give a forward vector of four costs, the rows behind it a backward one. They meet in the
middle, where the crossing state of the least sum is chosen; both halves are then solved
for themselves, so no table of costs is held besides the rows. Of equal sums the crossing
whose audit so far is least in ASCII order is taken. To know it, a forward vector also
ranks the best audits of its states: the audit of a row ends in K, R or D and has only I
before it, so no row's audit begins another one, and the order of parts is that of the whole.

Rows are dealt out by ranges of (conversation, turn, role, text) and sorted. A partition
holds whole conversations and, first and last, parts of two that may go on in others. For
such parts alone a table of costs from each state to each is made; by conversation the same
meeting of vectors is held over parts instead of rows, and every part is solved between its
two states. A conversation with a third of all rows is so shared by as many tasks as its
rows fill, and one record per part is gathered. Its repeated rows are found by digests, at
most one per part and text.

Defined results: null roles and texts count as one space, as does a null id or turn where
rows are drawn for damage. Null turns come first and do not count in gaps. Rows of equal
turns follow by role, the text's first 32 characters and a hash of the text; equal rows
are interchangeable. A null conversation id is a conversation of its own. Without rows all
counts are 0, the audit is empty and there are no turns. An empty table gives an empty
result. Columns besides the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

ROLES = ("user", "assistant")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Most characters of turns in one record, and most records in one batch.
PIECE_CHARS, BATCH_ROWS = 1 << 20, 2048
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
HEAD_CHARS = 32

# A row's first fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)
# States: the repaired rows end in nothing, s, u or a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60

Vector = tuple[tuple[int, int], ...]
"""(cost, rank of the audit) by state."""
Costs = tuple[int, ...]
Moves = tuple[tuple[int, int, int, object], ...]
"""(state, state after, cost, audit or its rank among those from the same state)."""
UNREACHED = (FAR, 0)


# --- one row ---------------------------------------------------------------


def kept(state: int, initial: str) -> int | None:
    """State after a kept turn, None where the order forbids it."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def paired(state: int) -> int:
    """State after the only turn of user or assistant that may follow."""
    return ASSISTANT if state == USER else USER


def row_kind(fault: int, role: str) -> str:
    """All that a row's costs depend on: its fault and, if it may stay, its initial."""
    if fault in (BLANK, DUPLICATE):
        return str(fault)
    return f"{fault}{role[0]}" if role[:1] in ("s", "u", "a") else f"{fault}"


@lru_cache(maxsize=None)
def row_moves(kind: str) -> Moves:
    """What a row of a kind may become. Inserted turns go before it; over two at once never pay."""
    fault, initial = int(kind[0]), kind[1:]
    extra = TRUNCATED if fault == CUT else 0
    found = []
    for start in range(4):
        state, cost, audit = start, 0, ""
        for _ in range(3):
            found.append((start, state, cost + DELETE, audit + "D"))
            if fault not in (BLANK, DUPLICATE):
                if (after := kept(state, initial)) is not None:
                    found.append((start, after, cost + extra, audit + "K"))
                found.append((start, paired(state), cost + REROLE + extra, audit + "R"))
            state, cost, audit = paired(state), cost + INSERT, audit + "I"
    return tuple(found)


@lru_cache(maxsize=None)
def row_audit(kind: str, start: int, end: int) -> str:
    """Cheapest letters of one row between two states, the least of equal ones."""
    return min((cost, audit) for s, e, cost, audit in row_moves(kind) if s == start and e == end)[1]


#: Inserted turns and costs that bring each state to a final one, nothing or a.
CLOSING = {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
CLOSING_COSTS: Costs = tuple(INSERT * len(CLOSING[s]) for s in range(4))


# --- vectors ---------------------------------------------------------------


def start_at(state: int) -> Vector:
    return tuple((0, 0) if s == state else UNREACHED for s in range(4))


def end_at(state: int) -> Costs:
    return tuple(0 if s == state else FAR for s in range(4))


def advance(vector: Vector, moves: Moves) -> Vector:
    """The forward vector behind one more row or part."""
    best: list = [None] * 4
    for start, after, cost, audit in moves:
        spent, rank = vector[start]
        if spent < FAR and (best[after] is None or (spent + cost, (rank, audit)) < best[after]):
            best[after] = (spent + cost, (rank, audit))
    order = sorted(b[1] for b in best if b)
    return tuple((b[0], order.index(b[1])) if b else UNREACHED for b in best)


def retreat(costs: Costs, moves: Moves) -> Costs:
    """The backward vector before one more row or part."""
    best = [FAR] * 4
    for start, after, cost, _ in moves:
        best[start] = min(best[start], costs[after] + cost)
    return tuple(best)


# Vectors of rows are kept relative to their least cost, so few occur and steps are looked up.
@lru_cache(maxsize=1 << 16)
def _row_advance(vector: Vector, kind: str) -> tuple[int, Vector]:
    found = advance(vector, row_moves(kind))
    least = min(c for c, _ in found)
    return least, tuple((c - least, r) if c < FAR else UNREACHED for c, r in found)


@lru_cache(maxsize=1 << 16)
def _row_retreat(costs: Costs, kind: str) -> tuple[int, Costs]:
    found = retreat(costs, row_moves(kind))
    least = min(found)
    return least, tuple(c - least if c < FAR else FAR for c in found)


def rows_forward(vector: Vector, kinds: Iterable[str]) -> Vector:
    base = 0
    for kind in kinds:
        least, vector = _row_advance(vector, kind)
        base += least
    return tuple((c + base, r) if c < FAR else UNREACHED for c, r in vector)


def rows_backward(costs: Costs, kinds: Iterable[str]) -> Costs:
    base = 0
    for kind in kinds:
        least, costs = _row_retreat(costs, kind)
        base += least
    return tuple(c + base if c < FAR else FAR for c in costs)


def parts_forward(vector: Vector, tables: Iterable[Moves]) -> Vector:
    for table in tables:
        vector = advance(vector, table)
    return vector


def parts_backward(costs: Costs, tables: Iterable[Moves]) -> Costs:
    for table in tables:
        costs = retreat(costs, table)
    return costs


def crossing(ahead: Vector, behind: Costs) -> int:
    """State of the least sum; of equal ones that of the least audit."""
    reached = [s for s in range(4) if ahead[s][0] < FAR and behind[s] < FAR]
    return min(reached, key=lambda s: (ahead[s][0] + behind[s], ahead[s][1]))


def meet(items: Sequence, start: int, end: int, ahead: Callable, behind: Callable) -> list[int]:
    """States around the items on the best way from one state to another, one more than items."""
    states = [start] + [end] * len(items)
    halves = [(0, len(items))]
    while halves:
        low, high = halves.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        states[middle] = crossing(
            ahead(start_at(states[low]), items[low:middle]),
            behind(end_at(states[high]), items[middle:high][::-1]),
        )
        halves += [(low, middle), (middle, high)]
    return states


def audits(kinds: list[str], start: int, end: int) -> list[str]:
    """Letters of each row on the best way between two states."""
    states = meet(kinds, start, end, rows_forward, rows_backward)
    return [row_audit(k, a, b) for k, a, b in zip(kinds, states, states[1:], strict=False)]


def table_of(kinds: list[str]) -> Moves:
    """Costs and ranks between all states over the rows of a part."""
    found = []
    for start in range(4):
        vector = rows_forward(start_at(start), kinds)
        found += [(start, after, c, r) for after, (c, r) in enumerate(vector) if c < FAR]
    return tuple(found)


# --- conversations and their parts -----------------------------------------


def row_digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def row_fault(text: str, repeated: bool) -> int:
    end = text.rstrip(WHITE)[-1:]
    if not end:
        return BLANK
    if repeated:
        return DUPLICATE
    return SOUND if end in ".!?" else CUT


def tally(turns: list, roles: list[str], faults: list[int]) -> dict:
    """Counts of rows in order; with the ends that a following part needs."""
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    return {
        "low": min(known, default=None),
        "high": max(known, default=None),
        "distinct": len(set(known)),
        "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(CUT),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "first": initials[0] if initials else None,
        "last": initials[-1] if initials else None,
    }


def gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


def repaired(letters: Iterable[str], roles: Iterable[str], texts: Iterable[str], state: int) -> list[dict]:
    """Turns that the letters of rows leave, from a state on."""
    turns = []
    for row, role, text in zip(letters, roles, texts, strict=True):
        for letter in row:
            if letter == "D":
                continue
            state = kept(state, role[:1]) if letter == "K" else paired(state)
            turns.append({"role": role if letter == "K" else ROLES[state - USER], "text": "" if letter == "I" else text})
    return turns


def closing_turns(state: int) -> list[dict]:
    return repaired([CLOSING[state]], [""], [""], state)


def repair_whole(rows: list[tuple]) -> dict:
    """Result of a conversation given as (turn, role, text) in order."""
    seen: set[bytes] = set()
    faults = []
    for _, role, text in rows:
        key = row_digest(role, text)
        faults.append(row_fault(text, key in seen))
        seen.add(key)
    turns, roles, texts = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
    kinds = [row_kind(f, r) for f, r in zip(faults, roles, strict=True)]
    ahead = rows_forward(start_at(EMPTY), kinds)
    last = crossing(ahead, CLOSING_COSTS)
    letters = audits(kinds, EMPTY, last)
    counts = tally(turns, roles, faults)
    return {
        "gaps": gaps(counts["low"], counts["high"], counts["distinct"]),
        **{name: counts[name] for name in ("blank", "duplicate", "truncated", "illegal")},
        "cost": ahead[last][0] + CLOSING_COSTS[last],
        "audit": "".join(letters) + CLOSING[last],
        "turns": repaired(letters, roles, texts, EMPTY) + closing_turns(last),
    }


# --- Spark -----------------------------------------------------------------

_TURNS = "ARRAY<STRUCT<role: STRING, text: STRING>>"
_COUNTS = "gaps LONG, blank LONG, duplicate LONG, truncated LONG, illegal LONG, cost LONG, audit STRING"
_WHOLE = f"STRUCT<{_COUNTS.replace(' LONG', ': LONG').replace(' STRING', ': STRING')}, turns: {_TURNS}>"
_ROW = "part INT, at LONG, turn LONG, role STRING, text STRING, gone BOOLEAN, digest BINARY, again BOOLEAN"
_TABLE = "ARRAY<STRUCT<start: INT, after: INT, cost: LONG, rank: INT>>"
_TALLY = (
    "low LONG, high LONG, distinct LONG, first_turn LONG, last_turn LONG, blank LONG, duplicate LONG, "
    "truncated LONG, illegal LONG, first STRING, last STRING"
)


def damage(table: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, turn, role, text, gone): rows damaged by a checksum of id and turn; dropped ones stay, marked."""
    blank = F.lit(" ")
    conv, turn = F.col(f"`{conv_col}`"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    draw = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    rows = table.select(
        conv.alias("conv"),
        turn.alias("turn"),
        F.when(draw == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (draw == 0).alias("gone"),
        F.when(draw == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of the conversations' order; the last key spreads equal rows."""
    keyed = rows.withColumn("deal", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", F.substring("text", 1, HEAD_CHARS), F.xxhash64("text"), "deal"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("deal")


def _yield(records: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, schema)


def _first_pass(conv_type: str, schema: pa.Schema) -> Callable:
    """Solve the conversations inside a partition; pass on the rows of its first and last one."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        size = 0
        conv, rows, seen, first = None, [], set(), True

        def record(at: int, turn, role, text, gone) -> dict:
            key = row_digest(role, text)
            row = {"conv": conv, "part": part, "at": at, "turn": turn, "role": role, "text": text, "gone": gone, "digest": key}
            row["again"] = key in seen and not gone
            if not gone:
                seen.add(key)
            return row

        at = 0
        for batch in batches:
            for key, turn, role, text, gone in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (rows or at) and key != conv:
                    if not first:
                        out.append({"conv": conv, "whole": repair_whole([r[:3] for r in rows if not r[3]])})
                    rows, first = [], False
                conv = key
                at += 1
                size += len(text)
                if first:
                    # Rows of the conversation that may have begun before go on at once.
                    out.append(record(at, turn, role, text, gone))
                else:
                    rows.append((turn, role, text, gone))
                if len(out) >= BATCH_ROWS or size >= PIECE_CHARS:
                    yield _yield(out, schema)
                    out, size = [], 0
        seen = set()
        for row in rows:
            at += 1
            out.append(record(at, *row))
            if len(out) >= BATCH_ROWS:
                yield _yield(out, schema)
                out = []
        if out:
            yield _yield(out, schema)

    return solve


def _part_rows(pdf: pd.DataFrame) -> tuple[list, list[str], list[str], list[int]]:
    pdf = pdf[~pdf["gone"]].sort_values("at")
    turns = [None if pd.isna(t) else int(t) for t in pdf["turn"]]
    roles, texts = pdf["role"].tolist(), pdf["text"].tolist()
    return turns, roles, texts, [row_fault(t, a) for t, a in zip(texts, pdf["again"], strict=True)]


def _summaries(schema: pa.Schema) -> Callable:
    """One record per part: counts, ends and the table of costs."""

    def summarise(table: pa.Table) -> pa.Table:
        pdf = table.select(["turn", "role", "text", "gone", "at", "again"]).to_pandas(integer_object_nulls=True)
        turns, roles, _, faults = _part_rows(pdf)
        kinds = [row_kind(f, r) for f, r in zip(faults, roles, strict=True)]
        moves = [dict(zip(("start", "after", "cost", "rank"), m, strict=True)) for m in table_of(kinds)]
        row = {"conv": table["conv"][0].as_py(), "part": table["part"][0].as_py(), **tally(turns, roles, faults), "moves": moves}
        return pa.Table.from_pylist([row], schema)

    return summarise


def _meetings(schema: pa.Schema) -> Callable:
    """States around the parts of a conversation, and its counts with the last part."""

    def join(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda p: p["part"])
        tables = [tuple((m["start"], m["after"], m["cost"], m["rank"]) for m in p["moves"]) for p in parts]
        ahead = parts_forward(start_at(EMPTY), tables)
        last = crossing(ahead, CLOSING_COSTS)
        states = meet(tables, EMPTY, last, parts_forward, parts_backward)
        filled = [p for p in parts if p["first"] is not None]
        lows, highs = ([p[c] for p in filled if p[c] is not None] for c in ("low", "high"))
        distinct = sum(p["distinct"] for p in filled)
        illegal = sum(p["illegal"] for p in filled)
        for a, b in zip(filled, filled[1:], strict=False):
            distinct -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
            illegal += a["last"] + b["first"] not in ("su", "ua", "au")
        counts = {
            "gaps": gaps(min(lows, default=None), max(highs, default=None), distinct),
            **{name: sum(p[name] for p in parts) for name in ("blank", "duplicate", "truncated")},
            "illegal": illegal,
            "cost": ahead[last][0] + CLOSING_COSTS[last],
        }
        rows = [
            {"conv": p["conv"], "part": p["part"], "before": a, "behind": b, "closing": p is parts[-1], **counts}
            for p, a, b in zip(parts, states, states[1:], strict=False)
        ]
        return pa.Table.from_pylist(rows, schema)

    return join


def _pieces(schema: pa.Schema) -> Callable:
    """Audit and repaired turns of a part, the turns in pieces of bounded size."""

    def solve(table: pa.Table) -> pa.Table:
        pdf = table.select(["turn", "role", "text", "gone", "at", "again"]).to_pandas(integer_object_nulls=True)
        before, behind = table["before"][0].as_py(), table["behind"][0].as_py()
        _, roles, texts, faults = _part_rows(pdf)
        kinds = [row_kind(f, r) for f, r in zip(faults, roles, strict=True)]
        letters = audits(kinds, before, behind)
        turns, audit = repaired(letters, roles, texts, before), "".join(letters)
        if table["closing"][0].as_py():
            turns, audit = turns + closing_turns(behind), audit + CLOSING[behind]
        rows, piece, size = [], [], 0
        for turn in turns:
            piece.append(turn)
            size += len(turn["text"])
            if size >= PIECE_CHARS:
                rows.append(piece)
                piece, size = [], 0
        rows.append(piece)
        head = {"conv": table["conv"][0].as_py(), "part": table["part"][0].as_py()}
        out = [{**head, "piece": i, "audit": "" if i else audit, "turns": p} for i, p in enumerate(rows)]
        return pa.Table.from_pylist(out, schema)

    return solve


@dataclass(frozen=True)
class Repairs:
    """Conversations solved in one task, and those solved by parts.

    whole: conv, counts, cost, audit and turns in one row. split: conv, counts, cost and
    audit. pieces: (conv, part, piece, turns) of the split ones, in that order.
    """

    whole: DataFrame
    split: DataFrame
    pieces: DataFrame


def _arrow(frame_schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(frame_schema))


def repair_conversations(rows: DataFrame) -> Repairs:
    """Repair (conv, turn, role, text, gone) rows; of those gone only the conversation is kept."""
    spark, kind = rows.sparkSession, rows.schema["conv"].dataType.simpleString()
    first = f"conv {kind}, whole {_WHOLE}, {_ROW}"
    dealt = _sorted(rows.select("conv", "turn", "role", "text", "gone"))
    passed = materialize(dealt.mapInArrow(_first_pass(kind, _arrow(first, spark)), first), "repair-first")
    whole = passed.filter("whole IS NOT NULL").select("conv", "whole.*")
    parted = passed.filter("whole IS NULL").drop("whole")

    # Of a text's first rows in the parts of a conversation only that of the first part is new.
    fresh = parted.filter("NOT again AND NOT gone")
    earliest = fresh.groupBy("conv", "digest").agg(F.min("part").alias("new_in"))
    later = (
        fresh.select("conv", "digest", "part", "at")
        .join(earliest.withColumnRenamed("conv", "c").withColumnRenamed("digest", "d"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
        .filter("part > new_in")
        .select(F.col("part").alias("later_part"), F.col("at").alias("later_at"))
    )
    # A row's partition and number there name it.
    known = parted.join(later, (F.col("part") == F.col("later_part")) & (F.col("at") == F.col("later_at")), "left")
    known = materialize(
        known.withColumn("again", F.col("again") | F.col("later_at").isNotNull()).drop("later_part", "later_at", "digest"),
        "repair-parts",
    )

    summary = f"conv {kind}, part INT, {_TALLY}, moves {_TABLE}"
    summaries = known.groupBy("conv", "part").applyInArrow(_summaries(_arrow(summary, spark)), summary)
    meeting = f"conv {kind}, part INT, before INT, behind INT, closing BOOLEAN, " + _COUNTS.removesuffix(", audit STRING")
    met = materialize(summaries.groupBy("conv").applyInArrow(_meetings(_arrow(meeting, spark)), meeting), "repair-met")
    # One conversation can be first or last of a part only once, so part and conversation are a key.
    ways = met.select(F.col("conv").alias("c"), F.col("part").alias("p"), "before", "behind", "closing")
    solving = known.join(ways, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    piece = f"conv {kind}, part INT, piece INT, audit STRING, turns {_TURNS}"
    pieces = materialize(solving.groupBy("conv", "part").applyInArrow(_pieces(_arrow(piece, spark)), piece), "repair-pieces")

    written = pieces.filter("piece = 0").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "audit"))).alias("audits"))
    written = written.select(F.col("conv").alias("c"), F.array_join("audits.audit", "").alias("audit"))
    counts = met.filter("closing").drop("part", "before", "behind", "closing")
    split = counts.join(written, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    return Repairs(whole, split, pieces.drop("audit"))


def lines(turns: str) -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def digests(pieces: DataFrame) -> DataFrame:
    """(conv, sha256) of conversations in pieces.

    The digest is a chain over a conversation's bytes, so they pass through one task, in
    order, piece by piece; only the digest's state is held.
    """
    kind = pieces.schema["conv"].dataType.simpleString()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, state, begun = None, None, False
        for batch in batches:
            for key, size, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if state is None or key != conv:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state, begun = key, hashlib.sha256(), False
                if size:
                    state.update((("\n" if begun else "") + text).encode())
                    begun = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, state.hexdigest()), types, strict=True)], names)

    schema = f"conv {kind}, sha256 STRING"
    arrow = _arrow(schema, pieces.sparkSession)
    names, types = arrow.names, arrow.types
    ordered = pieces.select("conv", F.size("turns").alias("size"), lines("turns").alias("text"), "part", "piece")
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    return ordered.select("conv", "size", "text").mapInArrow(chain, schema)
