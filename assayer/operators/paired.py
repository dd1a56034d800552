"""Paired comparison of two arms: effect, cluster bootstrap, exact tests, strata and transitions.

Only the first aggregate (episodes to tasks) sees the data. The bootstrap works on one row per cluster, and folds
its replicates into arrays of sums; clusters beyond a bound are joined to their draws instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.draws import draw
from assayer.functions.sqltext import BLANKS, count_of, has
from assayer.operators import resample
from assayer.operators.metrics import outcome, ratio
from assayer.operators.ranking import nth_values, number_rows
from assayer.session import settle

c = F.col


def task_rates(episodes: DataFrame, *extra: str) -> DataFrame:
    """Tasks that both arms attempted: outcome rates per arm and ``d = pt - pb``."""
    kinds = episodes.withColumn("outcome", outcome())

    def n_of(arm):
        return F.count_if(c("arm") == arm)

    def share_of(arm, kind):
        return ratio(F.count_if((c("arm") == arm) & (c("outcome") == kind)), n_of(arm))

    rates = kinds.groupBy("task", "cluster", *extra).agg(
        n_of("base").alias("nb"),
        n_of("treat").alias("nt"),
        share_of("base", "pass").alias("pb"),
        share_of("treat", "pass").alias("pt"),
        share_of("base", "nosub").alias("nosub_b"),
        share_of("treat", "nosub").alias("nosub_t"),
        share_of("base", "wrong").alias("wrong_b"),
        share_of("treat", "wrong").alias("wrong_t"),
    )
    return rates.where((c("nb") > 0) & (c("nt") > 0)).withColumn("d", c("pt") - c("pb"))


def paired_delta(rates: DataFrame) -> DataFrame:
    return rates.agg(
        F.count("*").alias("tasks"),
        F.round(100 * F.avg("pb"), 9).alias("base"),
        F.round(100 * F.avg("pt"), 9).alias("treat"),
        F.round(100 * F.avg("d"), 9).alias("delta"),
    )


def cluster_sums(rates: DataFrame) -> DataFrame:
    """One row per cluster: sum of differences and number of tasks."""
    return rates.groupBy("cluster").agg(F.sum("d").alias("s"), F.count("*").alias("n"))


def numbered(clusters: DataFrame) -> DataFrame:
    """Clusters with an index from 0; stretches of clusters are numbered apart, so there may be any number."""
    if "ix" in clusters.columns:
        return clusters
    return number_rows(clusters, [], ["cluster"], "_no").withColumn("ix", c("_no") - 1).drop("_no")


def cluster_table(rates: DataFrame) -> DataFrame:
    """One stored row per cluster, numbered, from which all figures of a report are formed."""
    sums = rates.groupBy("cluster").agg(
        F.sum("d").alias("s"), F.count("*").alias("n"), F.sum("pb").alias("pb"), F.sum("pt").alias("pt"), *outcomes()
    )
    return settle(numbered(sums))


def replicates(clusters: DataFrame, boot: int, salt: int) -> DataFrame:
    """(b, v) of ``boot`` resamples of as many clusters as there are: ``100 * sum(d) / tasks`` over the tasks drawn."""
    table = resample.held(clusters)
    if table is None:
        return replicates_by_joins(clusters, boot, salt)
    sums = resample.drawn_clusters(clusters.sparkSession, table, boot, salt)
    return sums.select("b", ratio(100 * c("s"), c("n")).alias("v"))


def replicates_by_joins(clusters: DataFrame, boot: int, salt: int) -> DataFrame:
    """The same for any number of clusters, with a row for each replicate and cluster drawn."""
    table = numbered(clusters)
    k = clusters.agg(F.count("*")).scalar()
    grid = (
        clusters.sparkSession.range(boot)
        .withColumnRenamed("id", "b")
        .withColumn("k", k)
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), c("k") - 1)))
        .select("b", draw(c("k"), salt, c("b"), c("j")).alias("ix"))
    )
    # draws of the same cluster are counted before the join
    times = grid.groupBy("b", "ix").agg(F.count("*").alias("times"))
    return (
        times.join(table, "ix")
        .groupBy("b")
        .agg(ratio(100 * F.sum(c("s") * c("times")), F.sum(c("n") * c("times"))).alias("v"))
    )


def interval(values: DataFrame, boot: int) -> DataFrame:
    """Percentile bounds at the 0-based places floor(.025 B) and floor(.975 B) - 1 of the sorted replicates."""
    ordered = F.array_sort(F.collect_list("v"))  # B values, B is a parameter
    return values.agg(ordered.alias("vs")).select(
        F.round(F.try_element_at("vs", F.lit(int(0.025 * boot) + 1)), 9).alias("lo"),
        F.round(F.try_element_at("vs", F.lit(max(int(0.975 * boot), 1))), 9).alias("hi"),
    )


def cluster_bootstrap(clusters: DataFrame, boot: int = 20000, salt: int = 0) -> DataFrame:
    return interval(replicates(clusters, boot, salt), boot)


def cluster_weighted(clusters: DataFrame) -> DataFrame:
    return clusters.agg(
        F.count("*").alias("clusters"), F.round(100 * F.avg(ratio("s", "n")), 9).alias("weighted_delta")
    )


def per_cluster(clusters: DataFrame) -> DataFrame:
    whole = clusters.agg(F.sum("n")).scalar()
    return clusters.select(
        "cluster",
        "n",
        F.round(100 * ratio("s", "n"), 9).alias("delta"),
        ratio(c("n"), whole).alias("share"),
    ).orderBy(F.desc("n"), "cluster")


def outcomes() -> list[Column]:
    return [
        F.count_if(c("pt") > c("pb")).alias("wins"),
        F.count_if(c("pt") < c("pb")).alias("losses"),
        F.count_if(c("pt") == c("pb")).alias("ties"),
    ]


def wins_losses(rates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rates.groupBy(*(keys or [])).agg(*outcomes())


def log_factorial(n: Column) -> Column:
    """ln n!: looked up below 10, from there on by Stirling's series (error below 1e-12)."""
    x = n.cast("double")
    table = F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(10)])
    series = (
        (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    )
    return F.when(n < 10, F.get(table, n.cast("int"))).otherwise(series)


def mcnemar(df: DataFrame, wins: str = "wins", losses: str = "losses") -> DataFrame:
    """Add ``p``: the exact two-sided binomial p-value of the discordant counts.

    Terms more than 20 * sqrt(n) below the middle are smaller than any double, so at most that many are formed.
    """
    n = c(wins) + c(losses)
    k = F.least(c(wins), c(losses))
    start = F.greatest(F.lit(0), F.floor(n / 2 - 20 * F.sqrt(n.cast("double"))) - 1).cast("bigint")

    def term(i):
        return F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * math.log(2.0))

    tail = F.aggregate(
        F.sequence(F.least(start, k), k), F.lit(0.0), lambda acc, i: acc + F.when(i < start, 0.0).otherwise(term(i))
    )
    return df.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def sign_flip(clusters: DataFrame, boot: int = 20000, salt: int = 0) -> DataFrame:
    """Share of random sign patterns over the clusters whose sum is at least as far from 0 as the observed one."""
    table = resample.held(clusters)
    if table is None:
        sums = flips_by_joins(clusters, boot, salt)
    else:
        sums = resample.flipped_clusters(clusters.sparkSession, table, boot, salt)
    observed = clusters.agg(F.abs(F.sum("s"))).scalar()
    return sums.agg(ratio(F.count_if(F.abs("s") >= observed - 1e-12), F.count("*")).alias("p_flip"))


def flips_by_joins(clusters: DataFrame, boot: int, salt: int) -> DataFrame:
    """(b, s) for any number of clusters, with a row for each replicate and cluster."""
    table = numbered(clusters)
    flips = clusters.sparkSession.range(boot).withColumnRenamed("id", "b")
    k = clusters.agg(F.count("*")).scalar()
    bits = flips.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1))).select(
        "b", c("j").alias("ix"), draw(2, salt, "flip", c("b"), c("j")).alias("up")
    )
    return bits.join(table, "ix").groupBy("b").agg(F.sum(F.when(c("up") == 1, c("s")).otherwise(-c("s"))).alias("s"))


def verdict(delta: Column, lo: Column, margin: float = 5.0) -> list[Column]:
    return [
        F.when(lo > 0, "beats base").otherwise("not distinguishable from base").alias("verdict"),
        F.when(delta >= margin, "meaningful").otherwise("below the margin").alias("effect"),
    ]


def strata(rates: DataFrame, seen: list) -> DataFrame:
    """Tasks on seen and unseen clusters, tasks the base solves at times and never; empty strata do not appear."""
    labels = F.array(
        F.when(c("cluster").isin(seen), "seen cluster").otherwise("unseen cluster"),
        F.when(c("pb") > 0, "base reachable").otherwise("base never"),
    )
    return (
        rates.withColumn("stratum", F.explode(labels))
        .groupBy("stratum")
        .agg(
            F.count("*").alias("n"),
            F.round(100 * F.avg("pb"), 9).alias("base"),
            F.round(100 * F.avg("pt"), 9).alias("treat"),
            F.round(100 * F.avg("d"), 9).alias("delta"),
        )
    )


def transitions(rates: DataFrame) -> DataFrame:
    """Where gained and lost pass mass came from and went to, in percent of the tasks."""
    nosub_fell = c("nosub_b") - c("nosub_t") >= c("wrong_b") - c("wrong_t")
    nosub_rose = c("nosub_t") - c("nosub_b") >= c("wrong_t") - c("wrong_b")
    kind = (
        F.when(c("d") > 0, F.when(nosub_fell, "nosub to pass").otherwise("wrong to pass"))
        .when(c("d") < 0, F.when(nosub_rose, "pass to nosub").otherwise("pass to wrong"))
    )
    whole = rates.agg(F.count("*")).scalar()
    moved = rates.withColumn("transition", kind).where(c("transition").isNotNull())
    mass = moved.groupBy("transition").agg(F.sum(F.abs("d")).alias("m"), F.count("*").alias("tasks"))
    return mass.select("transition", "tasks", F.round(100 * ratio(c("m"), whole), 9).alias("mass"))


def sql_shape(episodes: DataFrame) -> DataFrame:
    """Length and structure of the submitted SQL per arm, for passing episodes and for all that submitted."""
    text = F.trim(F.regexp_replace("sql", BLANKS, " "))
    u = F.concat(F.lit(" "), F.upper(text), F.lit(" "))
    shapes = episodes.where(F.length("sql") > 0).select(
        "arm",
        F.explode(
            F.array_compact(F.array(F.lit("all submitted"), F.when(c("passed"), "passing")))
        ).alias("which"),
        F.length(text).alias("chars"),
        count_of(u, " JOIN ").alias("joins"),
        (count_of(u, "(SELECT") + count_of(u, "( SELECT")).alias("subqueries"),
        u.startswith(" WITH").cast("int").alias("cte"),
        has(u, " OVER (", " OVER(").alias("windowed"),
    )
    by_length = shapes.groupBy("arm", "which", "chars").agg(
        F.count("*").alias("k"), *[F.sum(x).alias(x) for x in ("joins", "subqueries", "cte", "windowed")]
    )
    flat = by_length.groupBy("arm", "which").agg(
        F.sum("k").alias("n"),
        F.percentile("chars", 0.5, c("k")).alias("chars_median"),
        *[ratio(F.sum(x), F.sum("k")).alias(x) for x in ("joins", "subqueries", "cte", "windowed")],
    )
    q3 = nth_values(shapes, ["arm", "which"], "chars", chars_q3=F.floor(3 * c("n") / 4))
    return flat.join(q3, ["arm", "which"])


def seed_noise(episodes: DataFrame) -> DataFrame:
    """Spread of the pass counts over seeds, per arm."""
    by_seed = episodes.groupBy("arm", "seed").agg(F.count_if("passed").alias("p"), F.count("*").alias("n"))
    return by_seed.groupBy("arm").agg(
        F.count("*").alias("seeds"),
        ratio(F.sum("p"), F.sum("n")).alias("acc"),
        F.round(F.stddev_samp("p"), 9).alias("sd"),
        F.min("p").alias("fewest"),
        F.max("p").alias("most"),
    )


def power(values: DataFrame, margin: float = 5.0) -> DataFrame:
    """Spread of the bootstrap, the smallest effect found with 80 % power, and the power at ``margin``."""
    values = settle(values)  # one row per replicate
    spread = values.agg(F.stddev_samp("v").alias("sd"), F.avg("v").alias("centre"))
    sd, centre = spread.select("sd").scalar(), spread.select("centre").scalar()
    return values.agg(
        F.round(F.max(sd), 9).alias("sd"),
        F.round(2.8 * F.max(sd), 9).alias("mde"),
        ratio(F.count_if(c("v") - centre + margin > 1.96 * sd), F.count("*")).alias("power"),
    )


def attempt_power(
    rates: DataFrame, boot: int = 2000, salt: int = 0, margin: float = 5.0, seeds: tuple[tuple[int, int], ...] = ((3, 3), (8, 5), (8, 8))
) -> DataFrame:
    """(seeds, sd, mde, power) for treat x base attempts a task, by resampling clusters and attempts.

    ``sd`` is the spread of the effect, ``mde`` the smallest effect found with 80 % power, ``power`` the share of
    replicates that would tell an effect of ``margin`` points from none.
    """
    sums = resample.resampled_attempts(rates, boot, salt, list(seeds)).where(c("n") > 0)
    values = settle(sums.select(c("part").alias("seeds"), (100 * c("s") / c("n")).alias("v")))  # a row for each pair and replicate
    spread = values.groupBy("seeds").agg(F.stddev_samp("v").alias("sd"), F.avg("v").alias("centre"))
    return values.join(spread, "seeds").groupBy("seeds").agg(
        F.round(F.max("sd"), 9).alias("sd"),
        F.round(2.8 * F.max("sd"), 9).alias("mde"),
        ratio(F.count_if(c("v") - c("centre") + margin > 1.96 * c("sd")), F.count("*")).alias("power"),
    )


def cluster_effect(rates: DataFrame) -> DataFrame:
    """(tasks, clusters, icc, design_effect, mde): how much the tasks of a cluster resemble each other.

    One-way variance components of ``d`` from (n, sum, sum of squares) of each cluster, which merge in any order. The
    design effect is that of the mean cluster size; ``mde`` is the smallest effect in points that is found with 80 %
    power, with the variance of ``d`` enlarged by it. NULL with one cluster, or one task in each.
    """
    per = rates.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(c("d") * c("d")).alias("q"))
    whole = per.agg(
        F.count("*").alias("k"), F.sum("n").alias("m"), F.sum(c("n") * c("n")).alias("nn"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(c("s") * c("s") / c("n")).alias("between"),
    )
    k, m = c("k"), c("m")
    among = F.try_divide(c("between") - c("s") * c("s") / m, k - 1)
    within = F.try_divide(c("q") - c("between"), m - k)
    size = F.try_divide(m - c("nn") / m, k - 1)
    icc = F.try_divide(among - within, among + (size - 1) * within)
    design = 1 + (m / k - 1) * icc
    variance = F.try_divide(c("q") - c("s") * c("s") / m, m - 1)
    return whole.select(
        m.alias("tasks"), k.alias("clusters"), F.round(icc, 9).alias("icc"), F.round(design, 9).alias("design_effect"),
        F.round(280 * F.sqrt(F.greatest(design, F.lit(0.0)) * variance / m), 9).alias("mde"),
    )


def holm(tests: DataFrame, order: str) -> DataFrame:
    """Holm-corrected p-values; one row per test (a handful of checkpoints) enters the window."""
    by_p = Window.orderBy("p", order)
    m = tests.agg(F.count("*")).scalar()
    raw = F.least(F.lit(1.0), (m - F.row_number().over(by_p) + 1) * c("p"))
    so_far = by_p.rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("raw", raw).withColumn("p_holm", F.max("raw").over(so_far)).drop("raw")


def with_task_table(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Episodes of the listed tasks, with the cluster that the task table (``task, cluster``) states."""
    return episodes.drop("cluster").join(tasks.select("task", "cluster"), "task")


def ab_report(
    episodes: DataFrame,
    boot: int = 20000,
    salt: int = 0,
    margin: float = 5.0,
    tasks: DataFrame | None = None,
    seen: list | None = None,
) -> DataFrame:
    """Effect, interval, tests and verdict of treat against base in one row.

    With a task table only its tasks count, under its clusters. With ``seen`` clusters the row also has ``strata`` and
    ``transitions``, each a list with one entry per kind. Episodes are read once, for one row per cluster; only these
    two lists need the tasks again.
    """
    rates = task_rates(episodes if tasks is None else with_task_table(episodes, tasks))
    if seen is not None:
        rates = settle(rates)
    clusters = cluster_table(rates)

    def mean(column: str) -> Column:
        return F.round(100 * ratio(F.sum(column), F.sum("n")), 9)

    whole = clusters.agg(
        F.sum("n").alias("tasks"), mean("pb").alias("base"), mean("pt").alias("treat"), mean("s").alias("delta"),
        F.count("*").alias("clusters"), F.round(100 * F.avg(ratio("s", "n")), 9).alias("weighted_delta"),
        *[F.sum(x).alias(x) for x in ("wins", "losses", "ties")],
    )
    report = mcnemar(whole).withColumn("p_mcnemar", F.round("p", 9)).drop("p")
    bounds = cluster_bootstrap(clusters, boot, salt).select(F.struct("lo", "hi").alias("bounds"))
    report = report.withColumn("bounds", bounds.scalar()).withColumn("p_flip", sign_flip(clusters, boot, salt).scalar())
    report = report.select("*", "bounds.*").drop("bounds")
    if seen is not None:
        for name, kinds in (("strata", strata(rates, seen)), ("transitions", transitions(rates))):
            listed = kinds.agg(F.array_sort(F.collect_list(F.struct(*kinds.columns))))  # at most four kinds
            report = report.withColumn(name, listed.scalar())
    return report.select("*", *verdict(c("delta"), c("lo"), margin))
