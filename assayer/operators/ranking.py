"""Running sums and row numbers inside groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import settle


def running_totals(df: DataFrame, keys: list[str], order: list[Column | str], **sums: Column) -> DataFrame:
    """Add, per group and in order, the inclusive running sum of each value in ``sums``.

    ``order`` must fix the order of the rows of a group. Rows are range-partitioned on (keys, order), so a
    large group spreads over many tasks. Each task sums its own stretch, and the totals of the stretches before
    it (one row per stretch and group) are added. The range cut depends on sampling, so the cut is
    written out before the two uses of it.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    sort = [F.col(k) for k in keys] + order_cols
    valued = df.select("*", *[v.alias(f"_v_{n}") for n, v in sums.items()])
    cut = settle(
        valued.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_stretch", F.spark_partition_id())
    )
    totals = cut.groupBy("_stretch", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_stretch", *keys, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy("_stretch", *keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in sums])
    joined = local.alias("l").join(offsets.alias("o"), _same("l", "o", ["_stretch", *keys]))
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns], *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def _same(left: str, right: str, names: list[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def number_rows(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "position") -> DataFrame:
    """Row number from 1 inside each group."""
    return running_totals(df, keys, order, **{name: F.lit(1).cast("bigint")})


def nth_values(df: DataFrame, keys: list[str], value: str, **index_of: Column) -> DataFrame:
    """Per group, the elements of the ascending values at the 0-based indices ``index_of`` (functions of ``n``).

    Values are counted first, so a group costs one row per distinct value; all indices are read in one pass.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    ends = running_totals(counts, keys, [value], _end=F.col("_c"))
    joined = ends.join(sizes, keys) if keys else ends.withColumn("n", sizes.select("n").scalar())

    def picked(at: Column) -> Column:
        return F.min(F.when((F.col("_end") > at) & (F.col("_end") - F.col("_c") <= at), F.col(value)))

    return joined.groupBy(*keys).agg(*[picked(at.cast("bigint")).alias(name) for name, at in index_of.items()])
