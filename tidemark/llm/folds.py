"""Rows held out from learning, chosen by their id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_remainder(parts: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def held_out(parts: int, fold: int, id_col: str = "doc_id") -> Column:
    """Whether a row is in the fold; a null id is in none."""
    return F.coalesce(id_remainder(parts, id_col) == fold, F.lit(False))
