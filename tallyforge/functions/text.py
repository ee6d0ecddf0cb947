"""Description matching.

Rule patterns are searched unanchored in the description.  Only four metacharacters are escaped,
so the others stay live (``GROCER.NORTH`` matches ``GROCERXNORTH``); patterns are joined with
``|``.  An empty list or an empty pattern therefore matches every non-null description.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: the characters escaped in a rule pattern and the
# alternation separator.
ESCAPED_CHARACTERS = ("*", "+", "(", ")")
ALTERNATION = "|"


def escape_pattern(text: str) -> str:
    out = text
    for ch in ESCAPED_CHARACTERS:
        out = out.replace(ch, "\\" + ch)
    return out


def patterns_regex(patterns: Iterable[str]) -> str:
    """C9 + C10 on the driver: the whole rule as one regex literal (compiled once per task)."""
    return ALTERNATION.join(escape_pattern(p) for p in patterns)


def escape_pattern_col(c: Column) -> Column:
    """C9 on a pattern column, for rules that live in a table."""
    return F.regexp_replace(c, r"([*+()])", r"\\$1")


def patterns_regex_col(patterns: Column) -> Column:
    """C10 on an ARRAY<STRING> column."""
    return F.array_join(F.transform(patterns, escape_pattern_col), ALTERNATION)


def contains_text(col: Column, text: str) -> Column:
    """case-sensitive literal contains; the empty text keeps all rows (nulls included)."""
    if text == "":
        return F.lit(True)
    return col.contains(F.lit(text))
