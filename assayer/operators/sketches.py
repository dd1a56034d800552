"""Distinct counts for any period from stored sketches: values are read once a day, sketches are merged ever after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.session import written

c = F.col
LG_K = 12  # 4096 registers
#: The stated error of a HyperLogLog estimate is 1.04 / sqrt(registers), one standard deviation.
ERROR = 1.04 / (1 << LG_K) ** 0.5


def daily(rows: DataFrame, keys: list[str], day: str, counted: list[str]) -> DataFrame:
    """A stored row for each key and day, with a sketch of each counted column; map tasks send sketches, not values."""
    sketches = [F.hll_sketch_agg(x, LG_K).alias(x) for x in counted]
    return written(rows.groupBy(*keys, day).agg(*sketches), "sketches")


def merged(days: DataFrame, keys: list[str], periods: list[str], counted: list[str]) -> DataFrame:
    """Estimates per key, for the whole time and for each level of ``periods``, from the days' sketches alone."""
    sets = [[*keys, *periods[:n]] for n in range(len(periods), -1, -1)]
    unions = [F.hll_sketch_estimate(F.hll_union_agg(x)).alias(x) for x in counted]
    return days.groupingSets(sets, *keys, *periods).agg(*unions)


def exact(rows: DataFrame, key: str, day: str, counted: str, name: str) -> DataFrame:
    """Exact distinct counts by key as (level, key, yr, qtr, ``name``): level 2 by quarter, 1 by year, 0 for the whole time.

    A value crosses the shuffle once per year, with its quarters as bits (bit 0 for days that are unknown), and once
    for the whole time, whatever the rows.
    """
    value = c(counted)
    quarter = F.coalesce(F.quarter(day), F.lit(0))
    bit = F.element_at(F.array(*[F.lit(1 << q) for q in range(5)]), quarter + 1)
    seen = rows.select(key, F.year(day).alias("yr"), value, bit.alias("bit")).groupBy(key, "yr", value).agg(F.bit_or("bit").alias("bits"))
    has = [c("bits").bitwiseAND(F.lit(1 << q)) > 0 for q in range(5)]
    years = seen.groupBy(key, "yr").agg(
        F.count(value).alias("n"), *[F.bool_or(has[q]).alias(f"has{q}") for q in range(5)],
        *[F.count_if(has[q] & value.isNotNull()).alias(f"n{q}") for q in range(5)],
    )
    year = F.struct(F.lit(1).alias("level"), F.lit(None).cast("int").alias("qtr"), F.lit(True).alias("there"), c("n").alias(name))
    quarters = [
        F.struct(F.lit(2).alias("level"), F.lit(q or None).cast("int").alias("qtr"), c(f"has{q}").alias("there"), c(f"n{q}").alias(name))
        for q in range(5)
    ]
    levels = years.select(key, "yr", F.inline(F.array(year, *quarters))).where("there")
    whole = rows.select(key, value).distinct().groupBy(key).agg(F.count(value).alias(name)).withColumns(
        {"level": F.lit(0), "yr": F.lit(None).cast("int"), "qtr": F.lit(None).cast("int")}
    )
    columns = ["level", key, "yr", "qtr", name]
    return levels.select(*columns).unionByName(whole.select(*columns))


def near(estimate: str, exact: str, deviations: float = 4.0) -> Column:
    """Whether an estimate lies within so many standard deviations of the exact count."""
    return F.abs(c(estimate) - c(exact)) <= deviations * ERROR * c(exact) + 1
