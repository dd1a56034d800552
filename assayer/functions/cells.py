"""Cell values: text form, numeric reading and tolerant equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: two numbers are equal within this distance, or within this share of the larger one
ABS_TOLERANCE = 0.01
REL_TOLERANCE = 1e-9

NUMBER = r"^\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def number_of(text: Column) -> Column:
    """The number a text stands for, or NULL. Digit groups may be split by ``_``; suffixes are not numbers."""
    return F.when(text.rlike(NUMBER), F.regexp_replace(text, "_", "").try_cast("double"))


def numbers_close(a: Column, b: Column) -> Column:
    """Within the tolerance; infinities and NaN are close to nothing."""
    widest = F.greatest(F.abs(a), F.abs(b))
    return (widest < float("inf")) & (F.abs(a - b) <= F.greatest(REL_TOLERANCE * widest, F.lit(ABS_TOLERANCE)))


def cells_equal(a: Column, b: Column, a_num: Column | None = None, b_num: Column | None = None) -> Column:
    """Both missing, or the same text, or two numbers (also written as text) within the tolerance.

    The numeric readings can be handed in when they are at hand, so that they are not formed per pair.
    """
    x = number_of(a) if a_num is None else a_num
    y = number_of(b) if b_num is None else b_num
    close = F.coalesce(numbers_close(x, y), F.lit(False))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((a == b) | close)


def exact_text(value: Column, dtype: str) -> Column:
    """Text of a whole number or decimal with all its digits, in the form ``float_text`` has: 10.0, 12.5."""
    if not dtype.startswith("decimal"):
        return F.concat(value.cast("string"), F.lit(".0"))
    text = value.cast("string")
    trimmed = F.when(text.contains("."), F.rtrim(text, F.lit("0"))).otherwise(F.concat(text, F.lit(".")))
    return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)


def float_text(x: Column) -> Column:
    """Plain decimal text of a double with at least one digit after the point, as 10.0 or 12345678.25."""
    size = F.abs(x)
    wide = F.rtrim(x.cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide)
    # between a thousandth and ten million the cast is plain already
    outside = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    whole = F.concat(x.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    return F.when((size >= 1e16) & (size < 1e36), whole).when(outside, plain).when(size == 0, F.lit("0.0")).otherwise(x.cast("string"))
