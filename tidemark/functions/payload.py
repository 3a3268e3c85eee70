"""Reading loosely typed JSON fields, with the coercions of the event rules.

A payload is a VARIANT. An absent key gives SQL NULL, a JSON null gives a
variant of type VOID; the rules treat the two differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points that count as white space when text is trimmed.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed patterns: texts accepted as a float, and as an instant.
FLOAT_TEXT = (
    r"(?i)^[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+)?|inf(inity)?|nan)$"
)
INTEGER_TEXT = r"^[+-]?\d+(_\d+)*$"
ISO_TEXT = (
    r"^\d{4}-\d{2}-\d{2}([Tt _]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([Zz]|[+-]\d{2}:?\d{2})?)?$"
)
EPOCH_TEXT = r"^[+-]?\d+(\.\d+)?$"
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
EMPTY_DOCUMENT = rf"^{SPACE}*(\{{[ \t\r\n]*\}}{SPACE}*)?$"

# Texts of the non-text values that count as blank.
BLANK_TEXTS = ("false", "[]", "{}", "0", "0.0", "-0.0")

# Numbers above this count milliseconds, below it seconds.
EPOCH_MS_ABOVE = 2e10


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def field(payload: Column, name: str) -> Column:
    """The field as VARIANT: NULL when the key is absent."""
    return F.variant_get(payload, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """Type name of a field: STRING, BIGINT, DECIMAL(..), BOOLEAN, VOID, .."""
    return F.schema_of_variant(value)


def sql_text(value: str) -> str:
    """A SQL string literal that reads back as ``value``."""
    escaped = "".join(
        f"\\u{ord(c):04x}" if ord(c) < 32 or ord(c) > 126 else {"\\": "\\\\", "'": "\\'"}.get(c, c) for c in value
    )
    return f"'{escaped}'"


class Field:
    """One field of a payload as plain columns: value, kind and, if wanted, text.

    They are projected first (`value_column`, then `detail_columns`), so the rules
    below only compare columns. That keeps the generated code small enough for
    the JVM to compile. A measure is seldom text, so its text is read on demand.
    Rules are SQL texts: building a long expression call by call costs more than
    planning it.
    """

    def __init__(self, name: str, textual: bool = True):
        self.name = name
        self.value = f"_v_{name}"
        self.kind = f"_k_{name}"
        self.textual = textual
        self.text = f"_t_{name}" if textual else f"try_variant_get({self.value}, '$', 'string')"
        self.trimmed = f"trim(BOTH {sql_text(WHITESPACE)} FROM {self.text})"

    def value_column(self, record: str) -> str:
        return f"{record}.{self.name} AS {self.value}"

    def detail_columns(self) -> list[str]:
        label = f"schema_of_variant({self.value}) AS {self.kind}"
        if not self.textual:
            return [self.value, label]
        return [label, f"try_variant_get({self.value}, '$', 'string') AS {self.text}"]

    @property
    def as_text(self) -> str:
        """The text of a JSON string; NULL for any other kind."""
        return f"CASE WHEN {self.kind} = 'STRING' THEN {self.text} END"

    @property
    def is_blank(self) -> str:
        """Absent, null, zero, false, an empty container, or white space only."""
        blanks = ", ".join(sql_text(t) for t in BLANK_TEXTS)
        return (
            f"CASE WHEN {self.kind} = 'STRING' THEN {self.trimmed} = '' "
            f"ELSE {self.text} IS NULL OR {self.text} IN ({blanks}) END"
        )

    @property
    def integer(self) -> str:
        """Whole number: numbers truncate, text must be an integer, flags are 0/1.

        NULL when the value has no integer reading. An absent key counts as 0.
        """
        spelled = f"CASE WHEN {self.trimmed} RLIKE {sql_text(INTEGER_TEXT)} THEN try_cast(translate({self.trimmed}, '_', '') AS BIGINT) END"
        return (
            f"CASE WHEN {self.kind} IS NULL THEN 0L WHEN {self.kind} = 'STRING' THEN {spelled} "
            f"ELSE try_variant_get({self.value}, '$', 'bigint') END"
        )

    @property
    def double(self) -> str:
        """Number, flag or numeric text; NULL otherwise, 0 when absent."""
        spelled = f"CASE WHEN {self.trimmed} RLIKE {sql_text(FLOAT_TEXT)} THEN try_cast(translate({self.trimmed}, '_', '') AS DOUBLE) END"
        return (
            f"CASE WHEN {self.kind} IS NULL THEN 0D WHEN {self.kind} = 'STRING' THEN {spelled} "
            f"ELSE try_variant_get({self.value}, '$', 'double') END"
        )

    def is_whole(self, integer: str) -> str:
        """The number has no fraction part (text was checked by `integer`)."""
        return f"({self.kind} = 'STRING' OR try_variant_get({self.value}, '$', 'double') = {integer})"

    @property
    def is_iso(self) -> str:
        return f"coalesce({self.kind} = 'STRING' AND {self.text} RLIKE {sql_text(ISO_TEXT)}, false)"

    def instant(self, is_iso: str) -> str:
        """Timestamp from ISO text (no offset means UTC) or an epoch number."""
        clock = f"translate(upper(substring({self.text}, 12)), ',', '.')"
        seconds = f"regexp_replace({clock}, '^([0-9][0-9]:[0-9][0-9])([Z+-]|$)', '$1:00$2')"
        offset = f"regexp_replace({seconds}, '([+-][0-9][0-9])([0-9][0-9])$', '$1:$2')"
        plain = f"concat(substring({self.text}, 1, 10), 'T', {offset})"
        number = f"try_cast({self.text} AS DOUBLE)"
        countable = (
            f"CASE WHEN {self.kind} = 'STRING' THEN {self.text} RLIKE {sql_text(EPOCH_TEXT)} "
            f"ELSE {self.kind} IN ('BIGINT', 'DOUBLE') OR startswith({self.kind}, 'DECIMAL') END"
        )
        scale = f"CASE WHEN abs({number}) > {EPOCH_MS_ABOVE:.0f}D THEN 1000D ELSE 1000000D END"
        return (
            f"CASE WHEN {is_iso} THEN coalesce(try_to_timestamp({self.text}), try_to_timestamp({plain})) "
            f"WHEN {countable} THEN timestamp_micros(try_cast(round({number} * {scale}) AS BIGINT)) END"
        )

    def local_day(self, is_iso: str, instant: str) -> str:
        """Calendar day in the event's own offset: the ISO text says it directly."""
        return f"CASE WHEN {is_iso} THEN substring({self.text}, 1, 10) ELSE date_format({instant}, 'yyyy-MM-dd') END"


def with_document(df: DataFrame, raw: str, out: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``out``, the parsed text: a VARIANT, or with ``fields`` a struct of them.

    NULL unless the whole text is one JSON value (with ``fields``, one object).
    Spark's parser stops after the first value, so the text is read as the first
    of two list items; anything left over spoils the list or its length. White
    space that JSON does not know is trimmed only for texts that fail without.
    """
    if fields:
        item = "struct<" + ", ".join(f"{name}: variant" for name in fields) + ", _end: boolean>"
        closing, closed = ',{"_end":true}]', "_items[1]._end"
    else:
        item, closing, closed = "variant", ',"_end"]', "try_variant_get(_items[1], '$', 'string') = '_end'"

    def attempt(text: str) -> str:
        return f"from_json(concat('[', {text}, '{closing}'), 'array<{item}>', map('allowSingleQuotes', 'false'))"

    trimmed = f"trim(BOTH {sql_text(WHITESPACE)} FROM `{raw}`)"
    kept = [f"`{c}`" for c in df.columns]
    listed = df.selectExpr(*kept, f"coalesce({attempt(f'`{raw}`')}, {attempt(trimmed)}) AS _items")
    whole = f"size(_items) = 2 AND coalesce({closed}, false)"
    return listed.selectExpr(*kept, f"CASE WHEN {whole} THEN _items[0] END AS `{out}`")


def is_empty_object(raw: str) -> str:
    """Blank text or {}."""
    return f"coalesce(`{raw}` RLIKE {sql_text(EMPTY_DOCUMENT)}, false)"
