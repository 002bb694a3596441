"""JSON text written the way Python's ``json`` module writes it by default:
``", "`` and ``": "`` separators and ASCII-only output (``\\uXXXX`` escapes,
surrogate pairs above U+FFFF). Built from column expressions, so an items
feed can be written byte-for-byte like the original exporter's lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col_of

# The short escapes of JSON strings.
SHORT_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
                 ("\b", "\\b"), ("\f", "\\f")]
NEEDS_ESCAPE_RE = r'[\\"\x00-\x1f\x7f-\x{10FFFF}]'
TOKEN_RE = r'(?s)[^\\"\x00-\x1f\x7f-\x{10FFFF}]+|.'


def _escape_char(t: Column) -> Column:
    out = None
    for ch, esc in SHORT_ESCAPES:
        out = F.when(t == ch, F.lit(esc)) if out is None else out.when(t == ch, F.lit(esc))
    # UTF-16 code units in lower-case hex: one \\u escape per unit
    units = F.lower(F.hex(F.encode(t, "UTF-16BE")))
    escaped = F.when(F.length(units) == 8,
                     F.concat(F.lit("\\u"), F.substr(units, F.lit(1), F.lit(4)), F.lit("\\u"),
                              F.substr(units, F.lit(5), F.lit(4)))) \
        .otherwise(F.concat(F.lit("\\u"), units))
    return out.when(t.rlike(NEEDS_ESCAPE_RE), escaped).otherwise(t)


def json_string(c) -> Column:
    """A JSON string literal (quotes included) of ``c``; ``null`` for null."""
    s = col_of(c)
    body = F.when(s.rlike(NEEDS_ESCAPE_RE),
                  F.array_join(F.transform(F.regexp_extract_all(s, F.lit(TOKEN_RE), F.lit(0)), _escape_char), "")) \
        .otherwise(s)
    return F.when(s.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def json_object(fields: list[tuple[str, Column]]) -> Column:
    """``{"k": v, ...}`` in the given order; strings quoted, numbers as text, null as null."""
    parts = []
    for i, (name, value) in enumerate(fields):
        parts.append(F.lit(("{" if i == 0 else ", ") + '"' + name + '": '))
        parts.append(value)
    parts.append(F.lit("}"))
    return F.concat(*parts)


def json_number(c) -> Column:
    s = col_of(c)
    return F.when(s.isNull(), F.lit("null")).otherwise(s.cast("string"))
