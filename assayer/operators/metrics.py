"""Episode metrics.

An episode row has: ``arm, task, cluster, task_set, seed, hops, passed, submitted, via, hit_cap, gate, turns``.
Every function aggregates with partial sums first, so a hot task, set or arm costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def rate(flag: Column) -> Column:
    return F.try_divide(F.count_if(flag).cast("double"), F.count("*").cast("double"))


def ratio(part: Column | str, whole: Column | str) -> Column:
    a, b = (c(x) if isinstance(x, str) else x for x in (part, whole))
    return F.try_divide(a.cast("double"), b.cast("double"))


def outcome() -> Column:
    """pass; no submission at the cap, on an error or a malformed call; otherwise wrong."""
    silent = F.coalesce(c("hit_cap"), F.lit(False)) | c("via").isNull() | c("via").isin("error", "malformed")
    return F.when(F.coalesce(c("passed"), F.lit(False)), "pass").when(silent, "nosub").otherwise("wrong")


def counter(df: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """Counts of ``label`` per group as one map; a missing label counts under ``none``."""
    counts = df.groupBy(*keys, F.coalesce(c(label).cast("string"), F.lit("none")).alias("_l")).agg(
        F.count("*").alias("_n")
    )
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_l", "_n")))).alias(name)
    )


def pass_map(df: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """``label -> passes/episodes`` per group."""
    counts = df.groupBy(*keys, c(label).cast("string").alias("_l")).agg(
        F.count_if("passed").alias("_p"), F.count("*").alias("_n")
    )
    value = F.concat(c("_p").cast("string"), F.lit("/"), c("_n").cast("string"))
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(c("_l"), value.alias("v"))))).alias(name)
    )


def map_text(column: str) -> Column:
    shown = F.transform(
        F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return F.coalesce(F.array_join(shown, ","), F.lit(""))


def run_summary(episodes: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, cap and no-submit rates, errors, mean turns, failed gates and accuracy by hops."""
    flat = episodes.groupBy(*keys).agg(
        F.count("*").alias("n"),
        rate(c("passed")).alias("exec_acc"),
        rate(c("hit_cap")).alias("turn_cap_rate"),
        rate(~c("submitted")).alias("no_submit_rate"),
        F.count_if(c("via") == "error").alias("error_count"),
        ratio(F.sum("turns"), F.count("*")).alias("mean_turns"),
    )
    gates = counter(episodes.where(~c("passed")), keys, "gate", "gate_fail_counts")
    hops = pass_map(episodes, keys, "hops", "by_hops")
    return flat.join(gates, keys, "left").join(hops, keys, "left")


def eval_summary(episodes: DataFrame) -> DataFrame:
    """Accuracy overall, by seed, by set and by hops. A seed's accuracy is over the number of tasks."""
    sums = episodes.groupBy("seed", "task_set", "hops").agg(
        F.count("*").alias("n"),
        F.count_if("passed").alias("p"),
        F.count_if(~c("submitted")).alias("ns"),
        F.count_if("hit_cap").alias("cap"),
        F.sum("turns").alias("turns"),
    )
    tasks = episodes.select("task").distinct().agg(F.count("*")).scalar()
    by_seed = F.grouping("seed") == 0
    sets = sums.groupingSets([[], [c("seed")], [c("task_set")], [c("hops")]], c("seed"), c("task_set"), c("hops"))
    rows = sets.agg(
        F.when(by_seed, "seed")
        .when(F.grouping("task_set") == 0, "set")
        .when(F.grouping("hops") == 0, "hops")
        .otherwise("all")
        .alias("dim"),
        F.sum("n").alias("n"),
        F.sum("p").alias("p"),
        ratio(F.sum("ns"), F.sum("n")).alias("no_submit_rate"),
        ratio(F.sum("cap"), F.sum("n")).alias("turn_cap_rate"),
        ratio(F.sum("turns"), F.sum("n")).alias("mean_turns"),
    )
    key = F.coalesce(c("seed").cast("string"), c("task_set"), c("hops").cast("string"), F.lit("all"))
    base = F.when(c("dim") == "seed", tasks).otherwise(c("n"))
    return rows.select(
        "dim", key.alias("key"), "n", ratio(c("p"), base).alias("exec_acc"),
        "no_submit_rate", "turn_cap_rate", "mean_turns",
    )


def arm_table(episodes: DataFrame) -> DataFrame:
    kinds = episodes.withColumn("outcome", outcome())
    flat = kinds.groupBy("arm").agg(
        F.count("*").alias("n"),
        rate(c("passed")).alias("acc"),
        rate(c("outcome") == "nosub").alias("no_submit"),
        rate(c("outcome") == "wrong").alias("wrong"),
        rate(c("hit_cap")).alias("turn_cap"),
        ratio(F.sum("turns"), F.count("*")).alias("turns"),
    )
    return flat.join(pass_map(episodes, ["arm"], "seed", "by_seed"), "arm")


def regression_guard(scores: DataFrame, keys: list[str], from_step: int = 50, drop: float = 0.10) -> DataFrame:
    """First step from ``from_step`` on whose accuracy is more than ``drop`` below that of step 0.

    ``scores`` has ``step`` and ``acc`` per group; groups without a step 0 raise no alarm.
    """
    base = scores.where(c("step") == 0).select(*keys, c("acc").alias("base_acc"))
    late = scores.where(c("step") >= from_step).join(base, keys)
    return (
        late.where(c("acc") < c("base_acc") - drop)
        .groupBy(*keys)
        .agg(F.min(F.struct("step", "acc", "base_acc")).alias("first"))
        .select(*keys, "first.*")
    )


def turn_curve(episodes: DataFrame, width: int = 5) -> DataFrame:
    """Pass rate and share of the episodes by turns used: 0-5, 6-10, 11-15, ..."""
    bucket = F.greatest(F.ceil(c("turns") / width) - 1, F.lit(0)).cast("int")
    counts = episodes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("passed").alias("p"))
    whole = counts.agg(F.sum("n")).scalar()
    low = F.when(c("bucket") == 0, 0).otherwise(c("bucket") * width + 1)
    label = F.concat(low.cast("string"), F.lit("-"), ((c("bucket") + 1) * width).cast("string"))
    return counts.select(
        label.alias("turns"), "n", ratio("p", "n").alias("pass_rate"), ratio(c("n"), whole).alias("share")
    )


def task_counts(episodes: DataFrame, *extra: str) -> DataFrame:
    """Attempts and passes per task; ``extra`` columns must be fixed within a task."""
    return episodes.groupBy("task", *extra).agg(F.count("*").alias("n"), F.count_if("passed").alias("p"))


def passes_histogram(counts: DataFrame) -> DataFrame:
    """Tasks by their number of passes, with the shares of all that have at most 2 and at least 6.

    One row per number of passes enters the window, so it is bounded by the attempts of a task.
    """
    passes = counts.groupBy(c("p").cast("int").alias("passes")).agg(F.count("*").alias("tasks"))
    everything = Window.partitionBy()
    whole = F.sum("tasks").over(everything)

    def share(kept: Column) -> Column:
        return ratio(F.sum(F.when(kept, c("tasks")).otherwise(0)).over(everything), whole)

    return passes.select(
        "passes", "tasks", ratio(c("tasks"), whole).alias("share"),
        share(c("passes") <= 2).alias("share_few"), share(c("passes") >= 6).alias("share_many"),
    )


def zone() -> Column:
    return F.when(c("p") == 0, "unsolved").when(c("p") == c("n"), "saturated").otherwise("learnable")


def zones(counts: DataFrame) -> DataFrame:
    """Learnable, saturated and unsolved tasks among those run more than once, overall and by hops."""
    kinds = counts.where(c("n") > 1).groupBy("hops", zone().alias("zone")).agg(F.count("*").alias("k"))
    spread = kinds.rollup("hops").agg(
        F.grouping("hops").alias("is_total"),
        F.sum("k").alias("n"),
        *[
            F.coalesce(F.sum(F.when(c("zone") == z, c("k"))), F.lit(0)).alias(z)
            for z in ("learnable", "saturated", "unsolved")
        ],
    )
    scope = F.when(c("is_total") == 1, "all").otherwise(c("hops").cast("string"))
    return spread.where(c("n").isNotNull()).select(
        scope.alias("hops"), "n", "learnable", "saturated", "unsolved",
        ratio("learnable", "n").alias("learnable_share"),
    )


def pass_at_k(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Share of tasks solved at least once, and the unbiased estimate for ``k`` tries of tasks with n >= k."""
    misses = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.lit(1.0),
        lambda acc, i: acc * F.try_divide((c("n") - c("p") - i).cast("double"), (c("n") - i).cast("double")),
    )
    estimate = F.when(c("n") >= k, F.when(c("n") - c("p") < k, 1.0).otherwise(1.0 - misses))
    return counts.groupBy(*keys).agg(
        F.count("*").alias("tasks"),
        rate(c("p") > 0).alias("solved_once"),
        F.count_if((c("p") > 0) & (c("p") < c("n"))).alias("sometimes"),
        F.count_if(c("p") == 0).alias("never"),
        F.count_if(c("p") == c("n")).alias("always"),
        F.round(F.avg(estimate), 9).alias("pass_at_k"),
    )
