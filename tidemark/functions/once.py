"""Evaluate a projection once per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def evaluate_once(df: DataFrame, *columns: str) -> DataFrame:
    """Project ``columns`` behind a one-element generator.

    A filter on a computed column is pushed below its projection by copying the
    expression, so `parse(raw)` would run in the filter and again in the
    projection. Filters do not move below a generator's output, and a generator
    over an array of one struct stays inside whole-stage codegen, so the parse
    runs once.
    """
    names = ", ".join(f"`{name}`" for name in columns or df.columns)
    return df.selectExpr(f"inline(array(struct({names})))")
