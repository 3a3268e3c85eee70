"""Words of a text and their hashes, for operators that run numpy in tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Odd 64-bit constants of the mixing steps.
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between blanks, tabs and line breaks (U+0020, U+0009 to U+000D).

    Splitting bytes uses exactly these separators, and their lower-casing changes A-Z only.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hashes(found: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not found:
        return np.empty(0, np.uint64)
    column = np.empty(len(found), object)
    column[:] = found
    return pd.util.hash_array(column, categorize=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(31))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` values; one run of all if there are fewer, none of none."""
    if len(h) == 0:
        return h
    size = min(size, len(h))
    total = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        total = total * _MULTIPLIER + h[i : i + len(total)]
    return mix(total + np.uint64(size))
