"""Run one query under several parameter settings in one pass."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_any(conditions: list[Column]) -> Column:
    """Rows that any setting wants; this is what reaches the scan."""
    return reduce(or_, conditions)


def wanted_by(conditions: list[Column]) -> Column:
    """The settings that want a row, as an array of their numbers."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(i)) for i, cond in enumerate(conditions)]))


def tagged(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """Keep wanted rows and note the settings in ``variants``. Group by it and unfold after the aggregate,
    so rows are not multiplied by the number of settings."""
    return df.where(in_any(conditions)).withColumn("variants", wanted_by(conditions))


def unfold(df: DataFrame) -> DataFrame:
    return df.withColumn("variant", F.explode("variants")).drop("variants")


def setting(values: list) -> Column:
    """The value that belongs to the row's ``variant``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("variant") + 1)
