"""From compared snapshots and screened texts to one verdict per attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.sqltokens import QUERY_HEADS, read_state

c = F.col


def all_snapshots(judged: DataFrame, hidden: list[int]) -> DataFrame:
    """An attempt passes when it passes on every hidden snapshot; the first failing one is named."""
    failed = ~F.coalesce(c("ok"), F.lit(False))
    return (
        judged.where(c("snapshot").isin(hidden))
        .groupBy("task", "attempt")
        .agg(
            ((F.count("*") >= len(hidden)) & ~F.bool_or(failed)).alias("passed"),
            F.min(F.when(failed, c("snapshot"))).alias("first_failed"),
        )
    )


def first_failed_gate(gates: str, order: tuple[str, ...] = ("G0", "G1", "G3", "G4")) -> Column:
    """The first gate of the map that is missing or did not pass; NULL when all did. Diagnostics gates do not count."""
    passed = {g: F.coalesce(F.try_element_at(c(gates), F.lit(g)), F.lit(False)) for g in order}
    return F.coalesce(*[F.when(~passed[g], g) for g in order])


def screen(df: DataFrame, sql: str, catalog: list[str]) -> DataFrame:
    """Cheap screens of SQL text: one statement that reads, over known tables. Not a parser.

    ``tables`` lists the names after FROM and JOIN, in comma lists and brackets too, with or without quotes and schema,
    but no common table expressions and no functions; a quoted file name is a table that no catalog knows. ``has_from``
    is true if the text has a FROM clause. Null and empty texts are one statement that does not read.
    """
    known = F.array(*[F.lit(n.lower()) for n in catalog])
    read = df.withColumn("_read", read_state(c(sql)))
    return read.withColumns(
        {
            "one_statement": ~c("_read.goes_on"),
            "reads_only": c("_read.starts").isin(*QUERY_HEADS) & ~c("_read.writes"),
            "has_from": c("_read.has_from"),
            "tables": c("_read.tables"),
            "unknown_tables": F.size(F.array_except(c("_read.tables"), known)),
        }
    ).drop("_read")


def bounded_results(shape: DataFrame, cap: int) -> DataFrame:
    """A row for each snapshot a text ran on, with an ``error`` where the result has more than ``cap`` rows."""
    return shape.select("task", "attempt", "snapshot", F.when(c("n_rows") > cap, "too many rows").alias("error"))


def ladder(judged: DataFrame, screened: DataFrame, results: DataFrame, hidden: list[int]) -> DataFrame:
    """One verdict per attempt: ``task, attempt, gate, snapshot, why, passed``; ``gate`` is the first that failed.

    ``screened`` has the screens of each attempt's text, ``results`` a row with ``error`` for each snapshot it ran on, and
    ``judged`` ``ok`` and ``why`` for each snapshot that was compared. G0: one statement that reads. G1: known tables.
    Then the hidden snapshots in their order, up to the first that fails: G3 if the text did not run there or has no
    result, G4 if no gold was met.
    """
    keys = ["task", "attempt"]
    listed = F.array(*[F.lit(s) for s in hidden])
    runs = screened.select(*keys, F.posexplode(listed).alias("place", "snapshot"))
    ran = results.select(*keys, "snapshot", F.lit(True).alias("ran"), "error")
    events = runs.join(ran, [*keys, "snapshot"], "left").join(
        judged.select(*keys, "snapshot", "ok", "why"), [*keys, "snapshot"], "left"
    )
    broke = c("ran").isNull() | c("error").isNotNull()
    gate = F.when(broke, "G3").when(~F.coalesce(c("ok"), F.lit(False)), "G4")
    why = F.when(broke, F.coalesce(c("error"), F.lit("no result"))).otherwise(F.coalesce(c("why"), F.lit("not compared")))
    failed = events.select(*keys, F.struct("place", "snapshot", gate.alias("gate"), why.alias("why")).alias("f"))
    first = failed.where(c("f.gate").isNotNull()).groupBy(*keys).agg(F.min("f").alias("f"))
    read = c("one_statement") & c("reads_only")
    text = F.when(~read, "G0").when(c("unknown_tables") > 0, "G1")
    said = F.when(~read, "not one statement that reads").when(c("unknown_tables") > 0, "unknown table")
    stop = F.coalesce(text, c("f.gate"))
    return screened.join(first, keys, "left").select(
        *keys, stop.alias("gate"), F.when(text.isNull(), c("f.snapshot")).alias("snapshot"),
        F.coalesce(said, c("f.why"), F.lit("")).alias("why"), stop.isNull().alias("passed"),
    )


def hardcoded(screened: DataFrame, prints: DataFrame, keys: list[str]) -> DataFrame:
    """Answers that read no table, or whose result is the same on all of several snapshots."""
    pairs = prints.select(*keys, "snapshot", "fingerprint").distinct()
    moves = pairs.groupBy(*keys).agg(
        F.count("*").alias("snapshots"), F.count_distinct("fingerprint").alias("results")
    )
    fixed = F.coalesce((c("snapshots") > 1) & (c("results") == 1), F.lit(False))
    return screened.join(moves, keys, "left").withColumn("hardcoded", (F.size("tables") == 0) | fixed)


def gold_selfcheck(self_judged: DataFrame, prints: DataFrame, visible: int, hidden: list[int]) -> DataFrame:
    """Each gold passes against itself, has rows on the visible snapshot, and its frozen visible
    answer fails on at least one hidden snapshot."""
    own = self_judged.groupBy("task").agg(F.bool_and("ok").alias("passes_itself"))
    frozen = prints.where(c("snapshot") == visible).select("task", c("fingerprint").alias("frozen"))
    moved = (
        prints.where(c("snapshot").isin(hidden))
        .join(frozen, "task")
        .groupBy("task")
        .agg(F.count_if(c("fingerprint") == c("frozen")).alias("repeats"))
    )
    return (
        own.join(frozen.select("task", F.lit(True).alias("has_rows")), "task", "left")
        .join(moved, "task", "left")
        .select(
            "task",
            "passes_itself",
            F.coalesce("has_rows", F.lit(False)).alias("has_rows"),
            (F.coalesce("repeats", F.lit(0)) < len(hidden)).alias("frozen_fails"),
        )
    )
