"""Features of SQL text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\r\n\f]+"


def collapse(text: Column) -> Column:
    """One blank for every run of white space, trimmed, without closing semicolons."""
    return F.rtrim(F.trim(F.regexp_replace(text, BLANKS, " ")), F.lit(";"))


def show_literal(literal: Column) -> Column:
    """A date literal as plain ``YYYY-MM-DD`` text, any other literal without its quotes."""
    date = F.regexp_extract(literal, r"(?:CAST\(|date )'([0-9-]+)'", 1)
    return F.coalesce(F.nullif(date, F.lit("")), F.trim(literal, F.lit("'")))


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a plain string."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def has(text: Column, *needles: str) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found.cast("int")


def padded(sql: Column) -> Column:
    """Collapsed upper-case text with a blank at both ends, so that words can be matched with their blanks."""
    return F.concat(F.lit(" "), F.upper(collapse(sql)), F.lit(" "))
