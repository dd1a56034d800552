"""Repeatable draws: the same keys give the same number on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ticket(*keys) -> Column:
    """An integer below 2**32 from the first eight hex digits of md5 over the keys joined by ``|``."""
    text = F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw(n, *keys) -> Column:
    """A number in ``0 .. n-1``; ``n`` is a column or an integer."""
    return ticket(*keys) % (n if isinstance(n, Column) else F.lit(n).cast("bigint"))


def sql_ticket(*keys: str) -> str:
    """The same integer in the check SQL; keys are SQL expressions."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8) AS BIGINT)"
