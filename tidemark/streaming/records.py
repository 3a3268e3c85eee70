"""Stream records: a key and a base64 JSON value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.payload import strip

RECORD_SCHEMA = "key STRING, data STRING"


def encode(events: DataFrame, newline: bool = False) -> DataFrame:
    """Records of conformed events, keyed by user.

    With ``newline`` the JSON ends in a line feed, as delivery to files needs.
    """
    stamp = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ssXXX")
    fields = [stamp.alias(c) if c == "event_ts" else F.col(c) for c in events.columns]
    body = F.to_json(F.struct(*fields))
    text = F.concat(body, F.lit("\n")) if newline else body
    return events.select(
        F.col("user_id").alias("key"),
        F.base64(F.encode(text, "UTF-8")).alias("data"),
        F.octet_length(body).cast("bigint").alias("bytes"),
    )


def decode(data: Column) -> Column:
    """JSON text of a record value; a value that is not base64 is taken as JSON.

    Base64 written by Spark breaks lines, so white space inside is ignored.
    """
    trimmed = strip(data)
    packed = F.regexp_replace(trimmed, r"[\r\n]", "")
    binary = F.when(packed.rlike(r"^[A-Za-z0-9+/]+={0,2}$"), F.try_to_binary(packed, F.lit("base64")))
    return strip(F.coalesce(F.try_validate_utf8(binary.cast("string")), trimmed))


def publish(events: DataFrame, path: str, newline: bool = False) -> None:
    """Append records to a source folder that a stream reads."""
    encode(events, newline).select("key", "data").write.mode("append").json(path)
