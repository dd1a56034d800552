"""Choice of tasks by pass rate, difficulty, size and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.draws import ticket
from assayer.functions.sqltext import count_of, has, padded
from assayer.operators.metrics import ratio
from assayer.operators.ranking import nth_values

c = F.col


def passk_band(counts: DataFrame, low: float, high: float) -> DataFrame:
    """Tasks whose share of passes lies strictly between the bounds; unmeasured tasks have no row."""
    return counts.withColumn("p_hat", ratio("p", "n")).where((c("p_hat") > low) & (c("p_hat") < high))


def passk_report(counts: DataFrame, low: float, high: float) -> DataFrame:
    """Per source: tasks, tasks kept, quartiles of the kept rates by index and the clusters they come from."""
    rate = ratio("p", "n")
    inside = (rate > low) & (rate < high)
    sizes = counts.groupBy("task_set", "cluster").agg(F.count("*").alias("tasks"), F.count_if(inside).alias("k"))
    report = sizes.groupBy("task_set").agg(
        F.sum("tasks").alias("tasks"), F.sum("k").alias("kept"), F.count_if(c("k") > 0).alias("clusters")
    )
    kept = passk_band(counts, low, high).select("task_set", "p_hat")
    n = c("n")
    quartiles = nth_values(kept, ["task_set"], "p_hat", q1=F.floor(n / 4), q2=F.floor(n / 2), q3=F.floor(3 * n / 4))
    return report.join(quartiles, "task_set")


def contrast_band(counts: DataFrame, fewest: int, most: int) -> DataFrame:
    return counts.where(c("p").between(fewest, most))


def posterior() -> Column:
    """Shrunken pass rate (p + 1) / (n + 2)."""
    return ratio(c("p") + 1, c("n") + 2)


def difficulty(df: DataFrame, sql: str) -> DataFrame:
    """Add structure counts of SQL text and their weighted ``score``.

    Fixed values: the weights 2 join, 3 subquery, 1 group, 2 having, 1 case, 3 window, 1 product or quotient,
    2 set operation, 1 beyond 200 characters and 1 more beyond 350.
    """
    s = c("_s")
    features = {
        "joins": count_of(s, " JOIN "),
        "subqueries": count_of(s, "(SELECT") + count_of(s, "( SELECT"),
        "grouped": has(s, " GROUP BY "),
        "having": has(s, " HAVING "),
        "cases": count_of(s, " CASE "),
        "windowed": has(s, " OVER (", " OVER("),
        "arith": F.regexp_count(s, F.lit(r"[\w)]\s*[*/]\s*[\w(]")),
        "set_ops": has(s, " UNION ", " EXCEPT ", " INTERSECT "),
        "chars": F.length(s),
    }
    score = (
        2 * c("joins") + 3 * c("subqueries") + c("grouped") + 2 * c("having") + c("cases") + 3 * c("windowed")
        + c("arith") + 2 * c("set_ops") + (c("chars") > 200).cast("int") + (c("chars") > 350).cast("int")
    )
    return df.withColumn("_s", padded(c(sql))).withColumns(features).withColumn("score", score).drop("_s")


def score_histogram(scored: DataFrame, top: int = 12) -> DataFrame:
    return scored.groupBy(F.least(c("score"), F.lit(top)).alias("score")).agg(F.count("*").alias("n"))


def floor_exclude_size(
    items: DataFrame, sizes: DataFrame, done: DataFrame, floor: int, max_size: float, group: str, key: str
) -> DataFrame:
    """Items at or above the score floor, from groups of known and small enough size, not measured before."""
    small = sizes.where(c("size") <= max_size).select(group)
    return (
        items.where(c("score") >= floor)
        .join(small, group, "left_semi")
        .join(done.select(key), key, "left_anti")
    )


def capped_per_group(
    items: DataFrame, group: str, score: str, key: str, per_group: int, n: int, salt: int
) -> DataFrame:
    """Hardest first in ticket order, at most ``per_group`` of a group, ``n`` in all.

    The rank limit is applied in each map task before the shuffle, so a hot group sends ``per_group`` rows per task.
    """
    order = [F.desc(score), ticket(salt, c(key)), c(key)]
    ranked = items.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(c("_place") <= per_group).drop("_place").orderBy(*order).limit(n)
