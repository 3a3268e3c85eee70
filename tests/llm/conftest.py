from __future__ import annotations

import random

import pytest

SYLLABLES = "an be co da el fi go ha in jo ka le mi no or pa qu ra si to un ve".split()


def prose(seed: int, words: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 3))) for _ in range(words)]


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages and lines, odd and missing texts, repeated rows."""
    passage = " ".join(prose(99, 60))
    base = prose(1, 120)
    near = [*base[:50], "changed", *base[51:]]
    lines = "\n".join(" ".join(prose(s, 9)) for s in range(200, 206))
    rows: list[tuple[int | None, str | None]] = [
        (5, " ".join(base)),
        (3, " ".join(near)),
        (9, " ".join(base)),
        (12, " ".join(near).upper()),
        (20, "Start. " + passage + " end of it."),
        (21, "Another one. " + passage),
        (22, passage + " " + passage),
        (30, lines),
        (31, "own line here\n" + lines + "\nlast own line"),
        (32, "a line\na line\na line\na line"),
        (33, "\n\n  \n\t\n"),
        (40, ""),
        (41, None),
        (None, " ".join(prose(7, 80))),
        (None, None),
        (50, "one"),
        (51, "two words"),
        (52, " lead  and\ttabs \r\n end "),
        (53, "é ß ñ ▁ ▁▁ 日本 😀   x\x1ey"),
        (60, " ".join(prose(8, 5000))),
        (60, " ".join(prose(8, 5000))),
        (61, "tie tie tie " * 40),
        (62, "tie tie tie " * 40),
    ]
    return rows


@pytest.fixture
def documents(spark, texts):
    """The texts with further columns whose names the operators use themselves."""
    rows = [(i, t, "en", "x", 1, 2.0, ["y"]) for i, t in texts]
    schema = "doc_id LONG, text STRING, lang STRING, row STRING, class INT, score DOUBLE, ids ARRAY<STRING>"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def empty(documents):
    return documents.limit(0)
