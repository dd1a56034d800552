"""Column helpers for money, means and days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(value: Column | str, scale: int = 2) -> Column:
    """Sum put back on its decimal grid, so that it does not depend on the order partial sums merge in."""
    return F.round(F.sum(value), scale)


def mean(value: Column | str, scale: int = 2) -> Column:
    """Mean of values with ``scale`` decimals; NULL for an empty group."""
    return F.try_divide(total(value, scale), F.count(value))


def day(text: str) -> Column:
    """A date literal; compared with a timestamp column it folds to a constant the scan can use."""
    return F.lit(dt.date.fromisoformat(text))


def revenue() -> Column:
    """Line revenue after discount."""
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def share(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, NULL when the whole is zero."""
    return F.try_divide(100 * part.cast("double"), whole.cast("double"))


def year(value: Column | str) -> Column:
    return F.year(value).cast("int")
