"""Repair of conversations against brute force over whole conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tidemark.llm import queries, repair

CLASSES = "[^\x20\x09-\x0d]"


def damaged(rows):
    """{conv: [(turn, role, text)]} by the contract; rows of equal turns in input order."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        found[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in found.items()}


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        last = re.findall(CLASSES, text)[-1:]
        found.append(
            "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        )
        seen.add((role, text))
    return found


def brute(rows):
    """(cost, audit, lines): ways are listed forward as the texts they make; of those that end alike the least goes on."""
    found = faults(rows)
    order = re.compile("(s?(ua)+)?")

    def allowed(initials):
        return any(order.fullmatch(initials + end) for end in ("", "a", "ua"))

    def spread(ways):
        grown = list(ways)
        for _ in range(3):
            grown = grown + [
                (cost + 2, audit + "I", out + [(role, "")])
                for cost, audit, out in grown
                for role in ("user", "assistant")
                if allowed("".join(r[:1] for r, _ in out) + role[:1])
            ]
            grown = list({(c, a, tuple(o)): (c, a, o) for c, a, o in grown}.values())
        return grown

    ways = [(0, "", [])]
    for (_, role, text), fault in zip(rows, found, strict=True):
        nexts = []
        for cost, audit, out in spread(ways):
            nexts.append((cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            initials = "".join(r[:1] for r, _ in out)
            if role and allowed(initials + role[:1]) and role[0] in "sua":
                nexts.append((cost + extra, audit + "K", out + [(role, text)]))
            for new in ("user", "assistant"):
                if allowed(initials + new[0]):
                    nexts.append((cost + 2 + extra, audit + "R", out + [(new, text)]))
        best = {}
        for n in nexts:
            key = n[2][-1][0][:1] if n[2] else ""
            if key not in best or n[:2] < best[key][:2]:
                best[key] = n
        ways = list(best.values())
    final = [w for w in spread(ways) if order.fullmatch("".join(r[:1] for r, _ in w[2]))]
    cost, audit, out = min(final, key=lambda w: w[:2])
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def expected(rows):
    result = {}
    for conv, kept in damaged(rows).items():
        turns = [t for t, _, _ in kept if t is not None]
        found = faults(kept)
        initials = [r[:1] for _, r, _ in kept]
        cost, audit, text = brute(kept)
        result[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{k: found.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
        }
    return result


def talk(seed, conversations, length):
    draw = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(draw.randint(0, length)):
            role = draw.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "agent"])
            text = draw.choice(["Yes.", "No", " \t", "", None, f"What about {turn}?", "Long.\n", "x "])
            rows.append((conv if conv else None, draw.choice([turn, turn, turn * 3, -turn]) * 1000 + turn, role, text))
    return rows


SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, part INT, conv STRING, whole STRING"


def frame(spark, rows, parts):
    return spark.createDataFrame([(*r, 1, "c", "w") for r in rows], SCHEMA).repartition(parts)


def run(spark, monkeypatch, table):
    monkeypatch.setattr(queries, "_table", lambda *_: table)
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries.op12_repair(spark, "").collect()}


def test_small_conversations_against_all_ways(spark, monkeypatch):
    rows = talk(1, 60, 9)
    assert run(spark, monkeypatch, frame(spark, rows, 3)) == expected(rows)


def test_one_conversation_over_all_partitions(spark, monkeypatch):
    rows = [(7, t, r, x) for _, t, r, x in talk(2, 80, 9)]
    rows = [(c, i, r, x) for i, (c, _, r, x) in enumerate(rows)] + [(8, None, "user", "Hello."), (8, 3, None, None)]
    assert run(spark, monkeypatch, frame(spark, rows, 5)) == expected(rows)


def test_nulls_repeats_and_empty_table(spark, monkeypatch):
    same = [(None, None, None, None)] * 40 + [(3, 1, "user", "Same.")] * 500 + [(4, None, "assistant", "")]
    assert run(spark, monkeypatch, frame(spark, same, 2)) == expected(same)
    assert run(spark, monkeypatch, frame(spark, [], 1)) == {}


def test_long_conversation_keeps_no_table(spark):
    # One task's part: states found by halves equal those of a plain table of all costs.
    draw = random.Random(5)
    kinds = [draw.choice(["0u", "0a", "3u", "3a", "1", "2", "0s", "0", "3"]) for _ in range(3000)]
    behind = [repair.CLOSING_COSTS]
    for kind in reversed(kinds):
        behind.append(repair.retreat(behind[-1], repair.row_moves(kind)))
    behind.reverse()
    # Letter by letter the least move on a cheapest way.
    state, want = repair.EMPTY, []
    for i, kind in enumerate(kinds):
        moves = [m for m in repair.row_moves(kind) if m[0] == state and m[2] + behind[i + 1][m[1]] == behind[i][state]]
        move = min(moves, key=lambda m: m[3])
        want.append(move[3])
        state = move[1]
    last = repair.crossing(repair.rows_forward(repair.start_at(repair.EMPTY), kinds), repair.CLOSING_COSTS)
    assert "".join(repair.audits(kinds, repair.EMPTY, last)) == "".join(want)
    assert last == state


@pytest.mark.parametrize("letters", list(product("sua", repeat=3)))
def test_every_short_sequence(letters):
    roles = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(i, roles[c], f"{i}.") for i, c in enumerate(letters)]
    found = repair.repair_whole(rows)
    cost, audit, text = brute(rows)
    assert (found["cost"], found["audit"]) == (cost, audit)
    assert "\n".join(f"{t['role']}:{t['text']}" for t in found["turns"]) == text
