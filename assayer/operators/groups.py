"""Scores of attempts relative to their group, and resting of groups without signal.

An attempt row has the group keys, ``passed, submitted, gen_chars``. Group statistics are an aggregate
joined back to the attempts, so a group of any size is summed in parts and never held by one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.draws import ticket
from assayer.operators.metrics import ratio
from assayer.session import fresh_path, settle

c = F.col

FLAT = 1e-8


def shaped_reward(target: float = 6000, alpha: float = 0.1, no_submit: float = 0.0) -> Column:
    """No submission: ``no_submit``; wrong: 0; pass: 1, less ``alpha * ln(length / target)`` beyond the target."""
    excess = F.ln(c("gen_chars").cast("double") / float(target))
    shaped = F.greatest(F.lit(0.0), 1.0 - alpha * excess)
    long = (c("gen_chars") > target) & F.lit(alpha > 0)
    return (
        F.when(~c("submitted"), float(no_submit))
        .when(~c("passed"), 0.0)
        .when(long, shaped)
        .otherwise(1.0)
    )


def outcome_class(reward: Column) -> Column:
    return F.when(reward > 0, 1.0).otherwise(reward)


def scored(attempts: DataFrame, **params: float) -> DataFrame:
    rewarded = attempts.withColumn("reward", shaped_reward(**params))
    return rewarded.withColumn("outcome", outcome_class(c("reward")))


def group_stats(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: size, reward mean and spread, counts by kind and whether it carries a signal."""
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("reward").alias("mu"),
        F.stddev_pop("reward").alias("sd"),
        F.sum("reward").alias("reward_sum"),
        F.count_if("passed").alias("passes"),
        F.count_if(c("submitted") & ~c("passed")).alias("wrong"),
        F.count_if(~c("submitted")).alias("silent"),
        (F.var_pop("outcome") < FLAT).alias("flat"),
    )


def group_advantages(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """``(reward - mean) / sd`` inside each group; groups of one outcome class are left out."""
    kept = group_stats(attempts, keys).where(~c("flat")).select(*keys, "mu", "sd")
    return attempts.join(kept, keys).withColumn("advantage", F.try_divide(c("reward") - c("mu"), c("sd")))


def signal_kind() -> Column:
    """Contrast between passes and the rest, a contrast among failures only, or none."""
    return (
        F.when(c("flat"), "flat")
        .when((c("passes") > 0) & (c("passes") < c("n")), "pass contrast")
        .otherwise("submit contrast")
    )


def step_rows(groups: DataFrame) -> DataFrame:
    """Per step: reward mean, rates and how many groups and attempts carry a signal."""
    n = F.sum("n")
    return groups.groupBy("step").agg(
        F.round(ratio(F.sum("reward_sum"), n), 9).alias("reward_mean"),
        ratio(F.sum("passes"), n).alias("pass_rate"),
        ratio(F.sum("silent"), n).alias("no_submit_rate"),
        F.count_if(~c("flat")).alias("groups_kept"),
        F.coalesce(F.sum(F.when(~c("flat"), c("n"))), F.lit(0)).alias("n_in_batch"),
    )


def flat_streaks(groups: DataFrame) -> DataFrame:
    """Consecutive flat groups per task up to each step; one row per task and step enters the window."""
    in_order = Window.partitionBy("task").orderBy("step")
    resets = F.sum(F.when(c("flat"), 0).otherwise(1)).over(in_order)
    islands = groups.withColumn("island", resets)
    inside = Window.partitionBy("task", "island").orderBy("step")
    streak = F.sum(c("flat").cast("int")).over(inside).cast("int")
    return islands.withColumn("streak", streak).drop("island")


def recent_rate(groups: DataFrame, last: int) -> DataFrame:
    """Pass rate over the last ``last`` groups of a task, so that a rested task is judged again."""
    window = Window.partitionBy("task").orderBy("step").rowsBetween(-last + 1, 0)
    return groups.withColumn("recent", ratio(F.sum("passes").over(window), F.sum("n").over(window)))


def _fold(drop_after: int, readmit_after: int) -> Column:
    """Carry a task's ``streak`` and ``rested_at`` over its ``history``, the (step, flat) of a stretch in order."""

    def step(s, h):
        resting = s["rested_at"].isNotNull() & (h["step"] < s["rested_at"] + readmit_after)
        # a task that waited its time starts from 0
        carried = F.when(s["rested_at"].isNotNull(), 0).otherwise(s["streak"])
        streak = F.when(resting, s["streak"]).when(h["flat"], carried + 1).otherwise(0)
        drops = ~resting & h["flat"] & (streak >= drop_after)
        rested_at = F.when(resting, s["rested_at"]).when(drops, h["step"])
        return F.struct(streak.cast("int").alias("streak"), rested_at.cast("int").alias("rested_at"))

    history = F.coalesce("history", F.array().cast("array<struct<step:int,flat:boolean>>"))
    return F.aggregate(history, F.struct("streak", "rested_at"), step)


RESTS = "rested int, back int"


def rest_pool(
    groups: DataFrame, drop_after: int = 2, readmit_after: int = 25, needed: int = 8
) -> tuple[DataFrame, list[int]]:
    """Rests per task, ``(task, rested, back)``, and the steps at which all tasks came back.

    A task rests after ``drop_after`` flat groups in a row and returns ``readmit_after`` steps later with
    streak 0. When fewer than ``needed`` tasks are active at a step, all return at once and keep their streaks.
    """
    spark = groups.sparkSession
    tidy = settle(groups.select("task", c("step").cast("int").alias("step"), "flat"))
    first, last, pool = tidy.agg(F.min("step"), F.max("step"), F.count_distinct("task")).first()
    path = fresh_path(spark, "rests")

    def keep(rests: DataFrame) -> None:
        rests.write.mode("append").parquet(path)

    state, resets = fresh_state(tidy.select("task").distinct()), []
    if first is not None:
        state, resets = advance(tidy, state, first, last + 1, pool, keep, drop_after, readmit_after, needed)
    keep(open_rests(state, readmit_after))
    return spark.read.schema(f"task {tidy.schema['task'].dataType.simpleString()}, {RESTS}").parquet(path), resets


def fresh_state(tasks: DataFrame) -> DataFrame:
    """No streak and no rest for each of the distinct ``tasks``."""
    return tasks.select("task", F.lit(0).alias("streak"), F.lit(None).cast("int").alias("rested_at"))


def open_rests(state: DataFrame, readmit_after: int) -> DataFrame:
    """The rests that have not ended, with the step at which they are due."""
    return state.where("rested_at is not null").select(
        "task", c("rested_at").alias("rested"), (c("rested_at") + readmit_after).cast("int").alias("back")
    )


def advance(
    tidy: DataFrame, state: DataFrame, start: int, end: int, pool: int, keep: Callable[[DataFrame], None],
    drop_after: int, readmit_after: int, needed: int,
) -> tuple[DataFrame, list[int]]:
    """The state before step ``end`` from that before ``start``, and the steps at which all of ``pool`` tasks came back;
    ``keep`` gets the rests that ended on the way.

    The rule that few are active looks across tasks, so steps are taken in stretches of ``readmit_after``, each from the
    state of the tasks at its first step: within one, a task drops once at most and a step's resting tasks are a count
    over tasks. A stretch that breaks the rule is cut at the first such step and the next one starts there; only
    the cut stretch is read twice. A history holds the groups of one task in one stretch.
    """
    resets = []
    due, was_due = c("rested_at") + readmit_after, c("was") + readmit_after

    def folded(start: int, stop: int) -> DataFrame:
        """The state before step ``stop``; ``was`` is the rest that a task was in at ``start``."""
        steps = tidy.where((c("step") >= start) & (c("step") < stop))
        histories = steps.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("step", "flat"))).alias("history"))
        carried = _fold(drop_after, readmit_after)
        joined = state.join(histories, "task", "left").select("task", c("rested_at").alias("was"), carried.alias("now"))
        return settle(joined.select("task", "was", "now.streak", "now.rested_at"))

    def first_break(now: DataFrame, start: int, stop: int) -> int | None:
        """The first step of the stretch at which tasks rest and too few are active."""
        dropped = now.where(c("rested_at") >= start)
        changes = (
            now.where("was is not null").select(F.inline(F.array(
                F.struct(F.lit(start).alias("step"), F.lit(1).alias("by")), F.struct(was_due.alias("step"), F.lit(-1).alias("by"))
            )))
            .unionByName(dropped.select((c("rested_at") + 1).alias("step"), F.lit(1).alias("by")))
            .groupBy("step")
            .agg(F.sum("by").alias("by"))
        )
        # one row per step of the stretch
        resting = F.sum("by").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
        short = (c("resting") > 0) & (F.lit(pool) - c("resting") < needed)
        return changes.withColumn("resting", resting).where(short & (c("step") < stop)).agg(F.min("step")).first()[0]

    def rest(since: str, back: Column) -> list[Column]:
        return [c("task"), c(since).alias("rested"), back.cast("int").alias("back")]

    while start < end:
        stop = min(start + readmit_after, end)
        now = folded(start, stop)
        broken = first_break(now, start, stop)
        if broken is not None:
            stop = broken
            now = folded(start, stop)
            resets.append(stop)
        # those whose time is over by ``stop`` are back with streak 0; a return of the pool ends all other rests there
        waited = (due <= stop) & c("rested_at").isNotNull()
        new = (c("rested_at") >= start) & (due <= stop)
        ended = now.where(was_due <= stop).select(*rest("was", was_due)).unionByName(now.where(new).select(*rest("rested_at", due)))
        if broken is not None:
            ended = ended.unionByName(now.where(due > stop).select(*rest("rested_at", F.lit(stop))))
        keep(ended)
        stays = F.lit(broken is None) & ~waited
        state = now.select(
            "task", F.when(waited, 0).otherwise(c("streak")).alias("streak"), F.when(stays, c("rested_at")).alias("rested_at")
        )
        start = stop
    return state, resets


def sample_active(tasks: DataFrame, n: int, salt: int, group: int) -> DataFrame:
    """``n`` tasks per step in ticket order, with the seed of the first of their ``group`` attempts."""
    order = Window.partitionBy("step").orderBy(ticket(salt, c("step"), c("task")), "task")
    picked = tasks.withColumn("k", F.row_number().over(order) - 1).where(c("k") < n)
    seed = F.lit(salt).cast("bigint") * 1_000_000 + c("step") * 1_000 + c("k") * group
    return picked.withColumn("first_seed", seed.cast("bigint"))
