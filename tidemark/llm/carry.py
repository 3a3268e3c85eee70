"""Further columns of a row, taken through an operator as one value.

Packed into one struct they cannot clash with an operator's own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CARRIED = "carried"


def packed(docs: DataFrame, keep: list[str]) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in keep), F.lit(0).alias("_")).alias(CARRIED)


def with_carried(schema: str, frame: DataFrame) -> T.StructType:
    """The schema and, last, the carried column of `frame`."""
    return T.StructType([*T._parse_datatype_string(schema).fields, frame.schema[CARRIED]])


def others(docs: DataFrame, *used: str) -> list[str]:
    return [c for c in docs.columns if c not in used]
