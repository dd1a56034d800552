"""Writers: narrowed table exports and append-only logs; results bounded in size; resumable grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.draws import ticket
from assayer.operators.ranking import number_rows

c = F.col

WHOLE = ("tinyint", "smallint", "int", "bigint")


def narrowed(df: DataFrame) -> DataFrame:
    """Whole numbers, doubles and text only: decimals become doubles, dates ``YYYY-MM-DD``, the rest text."""

    def cast(name: str, dtype: str) -> Column:
        if dtype in WHOLE:
            return c(name).cast("bigint")
        if dtype in ("float", "double") or dtype.startswith("decimal"):
            return c(name).cast("double")
        if dtype in ("date", "timestamp", "timestamp_ntz"):
            return F.date_format(name, "yyyy-MM-dd")
        if dtype.startswith(("array", "map", "struct")):
            return F.to_json(name)
        return c(name).cast("string")

    return df.select(*[cast(n, d).alias(n) for n, d in df.dtypes])


def export_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = narrowed(df).write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add finished episodes to a JSON-lines log; a failed write leaves no rows behind."""
    df.write.mode("append").json(path)


def todo(tasks: DataFrame, seeds: list[int], done: DataFrame) -> DataFrame:
    """All (task, seed) pairs without a finished episode."""
    grid = tasks.select("task", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    return grid.join(done.select("task", "seed"), ["task", "seed"], "left_anti")


def sample_tasks(tasks: DataFrame, k: int, salt: int, wanted: DataFrame | None = None) -> DataFrame:
    """The listed tasks, then ``k`` of them in ticket order."""
    kept = tasks if wanted is None else tasks.join(wanted.select("task"), "task", "left_semi")
    return kept.orderBy(ticket(salt, c("task")), "task").limit(k)


def latest_per_step(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last written row of each step wins; partial maxima leave one row per step and map task."""
    rest = [x for x in rows.columns if x not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("_r")).select(*keys, *[c(f"_r.{x}").alias(x) for x in rest])


RANK_LIMIT = 1000  # Spark applies a limit on row numbers before the shuffle up to here


def bounded(rows: DataFrame, keys: list[str], order: list, cap: int, cut: bool) -> DataFrame:
    """Results with at most ``cap`` rows, and ``overflow`` on those that had more.

    With ``cut`` an oversized result keeps its first ``cap`` rows, otherwise it is an error and keeps one row
    without values. The flag is never lost. Sizes are counted apart. A task keeps the first rows of a result before
    the shuffle, where the cap is small; under a large cap rows are numbered in stretches, so that a huge result does
    not meet one task.
    """
    if cap <= RANK_LIMIT:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        first = rows.withColumn("_n", place).where(c("_n") <= cap)
    else:
        first = number_rows(rows, keys, order, "_n").where(c("_n") <= cap)
    sizes = rows.groupBy(*keys).agg((F.count("*") > cap).alias("overflow"))
    flagged = first.join(sizes, keys)
    if not cut:
        values = [x for x in rows.columns if x not in keys]
        flagged = flagged.where(~c("overflow") | (c("_n") == 1)).withColumns(
            {x: F.when(~c("overflow"), c(x)) for x in values}
        )
    return flagged.drop("_n")
