"""Episode metrics, paired statistics, selection by pass rate, group scores and resting."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from assayer.functions.draws import sql_ticket
from assayer.operators import groups as grp
from assayer.operators import metrics as m
from assayer.operators import paired as ab
from assayer.operators import selection as sel
from assayer.plans.views import ATTEMPTS_SQL, EPISODES_SQL, episodes, episodes_with_turns, group_sql
from assayer.registry import query

c = F.col
BOOT, SALT = 20000, 7
SEEN = [0, 3, 8, 15, 21]

# ---------------------------------------------------------------- metrics

OUTCOME_SQL = """CASE WHEN passed THEN 'pass' WHEN hit_cap OR via IS NULL OR via IN ('error', 'malformed') THEN 'nosub'
  ELSE 'wrong' END"""


@query(
    "m_run_summary",
    f"""
WITH {EPISODES_SQL}, g AS (SELECT arm, string_agg(gate || '=' || k, ',' ORDER BY gate) AS gate_fail_counts FROM
  (SELECT arm, gate, count(*) AS k FROM e WHERE NOT passed GROUP BY ALL) GROUP BY arm),
 h AS (SELECT arm, string_agg(hops || '=' || p || '/' || k, ',' ORDER BY hops) AS by_hops FROM
  (SELECT arm, hops, count(*) FILTER (passed) AS p, count(*) AS k FROM e GROUP BY ALL) GROUP BY arm)
SELECT arm, count(*) AS n, count(*) FILTER (passed)::DOUBLE / count(*) AS exec_acc,
  count(*) FILTER (hit_cap)::DOUBLE / count(*) AS turn_cap_rate,
  count(*) FILTER (NOT submitted)::DOUBLE / count(*) AS no_submit_rate,
  count(*) FILTER (via = 'error') AS error_count, sum(turns)::DOUBLE / count(*) AS mean_turns,
  any_value(gate_fail_counts) AS gate_fail_counts, any_value(by_hops) AS by_hops
FROM et JOIN g USING (arm) JOIN h USING (arm) GROUP BY arm""",
)
def m_run_summary(t):
    summary = m.run_summary(episodes_with_turns(t), ["arm"])
    return summary.withColumns({x: m.map_text(x) for x in ("gate_fail_counts", "by_hops")})


@query(
    "m_eval_by_seed_set",
    f"""
WITH {EPISODES_SQL}, k AS (SELECT count(DISTINCT task) AS tasks FROM e),
 s AS (SELECT CASE WHEN grouping(seed) = 0 THEN 'seed' WHEN grouping(task_set) = 0 THEN 'set'
   WHEN grouping(hops) = 0 THEN 'hops' ELSE 'all' END AS dim,
  coalesce(seed::VARCHAR, task_set, hops::VARCHAR, 'all') AS key, count(*) AS n, count(*) FILTER (passed) AS p,
  count(*) FILTER (NOT submitted)::DOUBLE / count(*) AS no_submit_rate,
  count(*) FILTER (hit_cap)::DOUBLE / count(*) AS turn_cap_rate, sum(turns)::DOUBLE / count(*) AS mean_turns
  FROM et GROUP BY GROUPING SETS ((), (seed), (task_set), (hops)))
SELECT dim, key, n, p::DOUBLE / CASE WHEN dim = 'seed' THEN tasks ELSE n END AS exec_acc, no_submit_rate,
  turn_cap_rate, mean_turns FROM s, k""",
)
def m_eval_by_seed_set(t):
    return m.eval_summary(episodes_with_turns(t))


@query(
    "m_outcome",
    f"WITH {EPISODES_SQL} SELECT arm, {OUTCOME_SQL} AS outcome, count(*) AS n FROM e GROUP BY ALL",
)
def m_outcome(t):
    return episodes(t).groupBy("arm", m.outcome().alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "m_arm_table",
    f"""
WITH {EPISODES_SQL}, o AS (SELECT *, {OUTCOME_SQL} AS outcome FROM et),
 h AS (SELECT arm, string_agg(seed || '=' || p || '/' || k, ',' ORDER BY seed) AS by_seed FROM
  (SELECT arm, seed, count(*) FILTER (passed) AS p, count(*) AS k FROM e GROUP BY ALL) GROUP BY arm)
SELECT arm, count(*) AS n, count(*) FILTER (passed)::DOUBLE / count(*) AS acc,
  count(*) FILTER (outcome = 'nosub')::DOUBLE / count(*) AS no_submit,
  count(*) FILTER (outcome = 'wrong')::DOUBLE / count(*) AS wrong,
  count(*) FILTER (hit_cap)::DOUBLE / count(*) AS turn_cap, sum(turns)::DOUBLE / count(*) AS turns,
  any_value(by_seed) AS by_seed FROM o JOIN h USING (arm) GROUP BY arm""",
)
def m_arm_table(t):
    return m.arm_table(episodes_with_turns(t)).withColumn("by_seed", m.map_text("by_seed"))


@query(
    "m_step_row",
    f"""
WITH {group_sql("cluster", "month_no")}
SELECT step, round(sum(reward_sum) / sum(n), 9) AS reward_mean, sum(passes)::DOUBLE / sum(n) AS pass_rate,
  sum(silent)::DOUBLE / sum(n) AS no_submit_rate, count(*) FILTER (NOT flat) AS groups_kept,
  coalesce(sum(n) FILTER (NOT flat), 0)::BIGINT AS n_in_batch FROM g GROUP BY step""",
)
def m_step_row(t):
    return grp.step_rows(nation_groups(t))


@query(
    "m_regression_guard",
    f"""
WITH {EPISODES_SQL}, s AS (SELECT task_set, month_no AS step, count(*) FILTER (passed)::DOUBLE / count(*) AS acc
  FROM e GROUP BY ALL), b AS (SELECT task_set, acc AS base_acc FROM s WHERE step = 0)
SELECT task_set, step, acc, base_acc FROM s JOIN b USING (task_set) WHERE step >= 50 AND acc < base_acc - 0.10
QUALIFY row_number() OVER (PARTITION BY task_set ORDER BY step) = 1""",
)
def m_regression_guard(t):
    scores = episodes(t).groupBy("task_set", c("month_no").alias("step")).agg(m.rate(c("passed")).alias("acc"))
    return m.regression_guard(scores, ["task_set"])


@query(
    "m_turn_bucket_curve",
    f"""
WITH {EPISODES_SQL}, b AS (SELECT CAST(greatest(ceil(turns / 5) - 1, 0) AS INTEGER) AS k, count(*) AS n,
  count(*) FILTER (passed) AS p FROM et GROUP BY 1)
SELECT CASE WHEN k = 0 THEN 0 ELSE k * 5 + 1 END || '-' || (k + 1) * 5 AS turns, n, p::DOUBLE / n AS pass_rate,
  n::DOUBLE / (SELECT sum(n) FROM b) AS share FROM b""",
)
def m_turn_bucket_curve(t):
    return m.turn_curve(episodes_with_turns(t))


@query(
    "m_passes_hist",
    f"""
WITH {EPISODES_SQL}, k AS (SELECT task, count(*) FILTER (passed) AS p FROM e GROUP BY task),
 h AS (SELECT CAST(p AS INTEGER) AS passes, count(*) AS tasks FROM k GROUP BY 1)
SELECT passes, tasks, tasks::DOUBLE / (SELECT sum(tasks) FROM h) AS share,
  (SELECT sum(tasks) FROM h WHERE passes <= 2)::DOUBLE / (SELECT sum(tasks) FROM h) AS share_few,
  coalesce((SELECT sum(tasks) FROM h WHERE passes >= 6), 0)::DOUBLE / (SELECT sum(tasks) FROM h) AS share_many
FROM h""",
)
def m_passes_hist(t):
    return m.passes_histogram(m.task_counts(episodes(t)))


COUNTS_SQL = f"""{EPISODES_SQL}, k AS (SELECT task, cluster, task_set, hops, count(*) AS n,
  count(*) FILTER (passed) AS p FROM e GROUP BY ALL)"""


def counts(t):
    return m.task_counts(episodes(t), "cluster", "task_set", "hops")


@query(
    "zones",
    f"""
WITH {COUNTS_SQL}, z AS (SELECT hops, CASE WHEN p = 0 THEN 'unsolved' WHEN p = n THEN 'saturated' ELSE 'learnable' END
  AS zone FROM k WHERE n > 1)
SELECT coalesce(hops::VARCHAR, 'all') AS hops, count(*) AS n, count(*) FILTER (zone = 'learnable') AS learnable,
  count(*) FILTER (zone = 'saturated') AS saturated, count(*) FILTER (zone = 'unsolved') AS unsolved,
  count(*) FILTER (zone = 'learnable')::DOUBLE / count(*) AS learnable_share FROM z GROUP BY ROLLUP (z.hops)""",
)
def zones(t):
    return m.zones(counts(t))


@query(
    "pass_at_k",
    f"""
WITH {COUNTS_SQL}, q AS (SELECT *, CASE WHEN n >= 4 THEN CASE WHEN n - p < 4 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE
  - (n - p)::DOUBLE / n * ((n - p - 1)::DOUBLE / (n - 1)) * ((n - p - 2)::DOUBLE / (n - 2))
  * ((n - p - 3)::DOUBLE / (n - 3)) END END AS est FROM k)
SELECT task_set, count(*) AS tasks, count(*) FILTER (p > 0)::DOUBLE / count(*) AS solved_once,
  count(*) FILTER (p > 0 AND p < n) AS sometimes, count(*) FILTER (p = 0) AS never, count(*) FILTER (p = n) AS always,
  round(avg(est), 9) AS pass_at_k FROM q GROUP BY task_set""",
)
def pass_at_k(t):
    return m.pass_at_k(counts(t), ["task_set"], 4)


# ---------------------------------------------------------------- selection by pass rate


@query(
    "sel_passk_band",
    f"""WITH {COUNTS_SQL} SELECT task, task_set, p::DOUBLE / n AS p_hat FROM k
WHERE p::DOUBLE / n > 0.2 AND p::DOUBLE / n < 0.5""",
)
def sel_passk_band(t):
    return sel.passk_band(counts(t), 0.2, 0.5).select("task", "task_set", "p_hat")


@query(
    "sel_passk_report",
    f"""
WITH {COUNTS_SQL}, b AS (SELECT *, p::DOUBLE / n AS p_hat FROM k),
 f AS (SELECT * FROM b WHERE p_hat > 0 AND p_hat < 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY task_set ORDER BY p_hat) - 1 AS ix,
   count(*) OVER (PARTITION BY task_set) AS kept FROM f)
SELECT task_set, (SELECT count(*) FROM k WHERE k.task_set = r.task_set) AS tasks, max(kept) AS kept,
  max(p_hat) FILTER (ix = kept // 4) AS q1, max(p_hat) FILTER (ix = kept // 2) AS q2,
  max(p_hat) FILTER (ix = 3 * kept // 4) AS q3, count(DISTINCT cluster) AS clusters FROM r GROUP BY task_set""",
)
def sel_passk_report(t):
    return sel.passk_report(counts(t), 0.0, 1.0)


@query(
    "sel_contrast_band",
    f"WITH {COUNTS_SQL} SELECT task, n, p FROM k WHERE p BETWEEN 2 AND 6",
)
def sel_contrast_band(t):
    return sel.contrast_band(counts(t), 2, 6).select("task", "n", "p")


@query(
    "sel_beta_posterior",
    f"""WITH {COUNTS_SQL} SELECT task_set, count(*) AS tasks, round(avg(p::DOUBLE / n), 9) AS mean_rate,
  round(avg((p + 1)::DOUBLE / (n + 2)), 9) AS mean_posterior FROM k GROUP BY task_set""",
)
def sel_beta_posterior(t):
    return (
        counts(t)
        .groupBy("task_set")
        .agg(
            F.count("*").alias("tasks"),
            F.round(F.avg(m.ratio("p", "n")), 9).alias("mean_rate"),
            F.round(F.avg(sel.posterior()), 9).alias("mean_posterior"),
        )
    )


# ---------------------------------------------------------------- paired statistics

RATES_SQL = f"""{EPISODES_SQL}, o AS (SELECT *, {OUTCOME_SQL} AS outcome FROM e),
c1 AS (SELECT task, cluster, task_set, count(*) FILTER (arm = 'base') AS nb, count(*) FILTER (arm = 'treat') AS nt,
  {", ".join(f"count(*) FILTER (arm = '{a}' AND outcome = '{k}') AS {k}_{a}" for a in ("base", "treat")
             for k in ("pass", "nosub", "wrong"))} FROM o GROUP BY ALL HAVING nb > 0 AND nt > 0),
r AS (SELECT *, pass_base::DOUBLE / nb AS pb, pass_treat::DOUBLE / nt AS pt, pass_treat::DOUBLE / nt - pass_base::DOUBLE / nb AS d,
  nosub_base::DOUBLE / nb AS nosub_b, nosub_treat::DOUBLE / nt AS nosub_t, wrong_base::DOUBLE / nb AS wrong_b,
  wrong_treat::DOUBLE / nt AS wrong_t FROM c1),
cl AS (SELECT cluster, sum(d) AS s, count(*) AS n, row_number() OVER (ORDER BY cluster) - 1 AS ix FROM r GROUP BY cluster)
"""

BOOT_SQL = f"""{RATES_SQL}, kk AS (SELECT count(*) AS k FROM cl),
dr AS (SELECT b, {sql_ticket(str(SALT), "b", "j")} % k AS ix FROM range({BOOT}) bb(b), kk, range(1000) jj(j) WHERE j < k),
rep AS (SELECT b, 100 * sum(s) / sum(n) AS v FROM dr JOIN cl USING (ix) GROUP BY b),
ci AS (SELECT round(vs[{int(0.025 * BOOT) + 1}], 9) AS lo, round(vs[{int(0.975 * BOOT)}], 9) AS hi
  FROM (SELECT list_sort(list(v)) AS vs FROM rep))
"""

FLIP_SQL = f"""fl AS (SELECT b, sum(CASE WHEN {sql_ticket(str(SALT), "'flip'", "b", "ix")} % 2 = 1 THEN s ELSE -s END) AS v
  FROM range({BOOT}) bb(b), cl GROUP BY b),
pf AS (SELECT count(*) FILTER (abs(v) >= (SELECT abs(sum(s)) FROM cl) - 1e-12)::DOUBLE / count(*) AS p_flip FROM fl)"""

MCNEMAR_SQL = """least(1.0::DOUBLE, 2 * list_sum([exp(lgamma(wins + losses + 1) - lgamma(i + 1)
  - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)) for i in generate_series(0, least(wins, losses))]))"""

WINS_SQL = "count(*) FILTER (pt > pb) AS wins, count(*) FILTER (pt < pb) AS losses, count(*) FILTER (pt = pb) AS ties"


def rates(t):
    return ab.task_rates(episodes(t), "task_set")


def clusters(t):
    return ab.cluster_sums(rates(t))


@query(
    "ab_paired_delta",
    f"""WITH {RATES_SQL} SELECT count(*) AS tasks, round(100 * avg(pb), 9) AS base, round(100 * avg(pt), 9) AS treat,
  round(100 * avg(d), 9) AS delta FROM r""",
)
def ab_paired_delta(t):
    return ab.paired_delta(rates(t))


@query("ab_cluster_bootstrap", f"WITH {BOOT_SQL} SELECT lo, hi FROM ci")
def ab_cluster_bootstrap(t):
    return ab.cluster_bootstrap(clusters(t), BOOT, SALT)


@query(
    "ab_db_weighted",
    f"WITH {RATES_SQL} SELECT count(*) AS clusters, round(100 * avg(s / n), 9) AS weighted_delta FROM cl",
)
def ab_db_weighted(t):
    return ab.cluster_weighted(clusters(t))


@query(
    "ab_per_cluster",
    f"""WITH {RATES_SQL} SELECT cluster, n, round(100 * (s / n), 9) AS delta, n::DOUBLE / (SELECT sum(n) FROM cl) AS share
FROM cl""",
)
def ab_per_cluster(t):
    return ab.per_cluster(clusters(t))


@query(
    "ab_mcnemar",
    f"""WITH {RATES_SQL}, w AS (SELECT cluster, {WINS_SQL} FROM r GROUP BY cluster)
SELECT cluster, wins, losses, ties, round({MCNEMAR_SQL}, 9) AS p FROM w""",
)
def ab_mcnemar(t):
    return ab.mcnemar(ab.wins_losses(rates(t), ["cluster"])).withColumn("p", F.round("p", 9))


@query("ab_sign_flip", f"WITH {RATES_SQL}, {FLIP_SQL} SELECT p_flip FROM pf")
def ab_sign_flip(t):
    return ab.sign_flip(clusters(t), BOOT, SALT)


@query(
    "ab_verdict",
    f"""WITH {BOOT_SQL}, dd AS (SELECT round(100 * avg(d), 9) AS delta FROM r)
SELECT delta, lo, hi, CASE WHEN lo > 0 THEN 'beats base' ELSE 'not distinguishable from base' END AS verdict,
  CASE WHEN delta >= 5 THEN 'meaningful' ELSE 'below the margin' END AS effect FROM dd, ci""",
)
def ab_verdict(t):
    delta = ab.paired_delta(rates(t)).select("delta").scalar()
    bounds = ab.cluster_bootstrap(clusters(t), BOOT, SALT).withColumn("delta", delta)
    return bounds.select("delta", "lo", "hi", *ab.verdict(c("delta"), c("lo")))


@query(
    "ab_report",
    f"""WITH {BOOT_SQL}, {FLIP_SQL}, w AS (SELECT count(*) AS tasks, round(100 * avg(pb), 9) AS base,
  round(100 * avg(pt), 9) AS treat, round(100 * avg(d), 9) AS delta, {WINS_SQL} FROM r)
SELECT tasks, base, treat, delta, lo, hi, (SELECT count(*) FROM cl) AS clusters,
  (SELECT round(100 * avg(s / n), 9) FROM cl) AS weighted_delta, wins, losses, ties,
  round({MCNEMAR_SQL}, 9) AS p_mcnemar, p_flip,
  CASE WHEN lo > 0 THEN 'beats base' ELSE 'not distinguishable from base' END AS verdict,
  CASE WHEN delta >= 5 THEN 'meaningful' ELSE 'below the margin' END AS effect FROM w, ci, pf""",
)
def ab_report(t):
    return ab.ab_report(episodes(t), BOOT, SALT)


@query(
    "ab_strata",
    f"""WITH {RATES_SQL}, s AS (SELECT *, unnest([CASE WHEN cluster IN (0, 3, 8, 15, 21) THEN 'seen cluster'
   ELSE 'unseen cluster' END, CASE WHEN pb > 0 THEN 'base reachable' ELSE 'base never' END]) AS stratum FROM r)
SELECT stratum, count(*) AS n, round(100 * avg(pb), 9) AS base, round(100 * avg(pt), 9) AS treat,
  round(100 * avg(d), 9) AS delta FROM s GROUP BY stratum""",
)
def ab_strata(t):
    return ab.strata(rates(t), SEEN)


@query(
    "ab_transitions",
    f"""WITH {RATES_SQL}, s AS (SELECT *, CASE
  WHEN d > 0 THEN CASE WHEN nosub_b - nosub_t >= wrong_b - wrong_t THEN 'nosub to pass' ELSE 'wrong to pass' END
  WHEN d < 0 THEN CASE WHEN nosub_t - nosub_b >= wrong_t - wrong_b THEN 'pass to nosub' ELSE 'pass to wrong' END
  END AS transition FROM r)
SELECT transition, count(*) AS tasks, round(100 * (sum(abs(d)) / (SELECT count(*) FROM r)), 9) AS mass FROM s
WHERE transition IS NOT NULL GROUP BY transition""",
)
def ab_transitions(t):
    return ab.transitions(rates(t))


@query(
    "ab_sql_shape",
    rf"""WITH {EPISODES_SQL}, s AS (SELECT arm, passed, trim(regexp_replace(sql, '[ \t\r\n\f]+', ' ', 'g')) AS x FROM e
  WHERE length(sql) > 0),
 u AS (SELECT arm, unnest(CASE WHEN passed THEN ['all submitted', 'passing'] ELSE ['all submitted'] END) AS which,
  length(x) AS chars, ' ' || upper(x) || ' ' AS u FROM s),
 f AS (SELECT arm, which, chars, len(regexp_extract_all(u, ' JOIN ')) AS joins,
  len(regexp_extract_all(u, '\( ?SELECT')) AS subqueries, u LIKE ' WITH%' AS cte,
  u LIKE '% OVER (%' OR u LIKE '% OVER(%' AS windowed FROM u)
SELECT arm, which, count(*) AS n, median(chars) AS chars_median, sum(joins)::DOUBLE / count(*) AS joins,
  sum(subqueries)::DOUBLE / count(*) AS subqueries, count(*) FILTER (cte)::DOUBLE / count(*) AS cte,
  count(*) FILTER (windowed)::DOUBLE / count(*) AS windowed,
  CAST(list_sort(list(chars))[1 + 3 * count(*) // 4] AS INTEGER) AS chars_q3 FROM f GROUP BY ALL""",
)
def ab_sql_shape(t):
    return ab.sql_shape(episodes(t))


@query(
    "ab_seed_noise",
    f"""WITH {EPISODES_SQL}, s AS (SELECT arm, seed, count(*) FILTER (passed) AS p, count(*) AS n FROM e GROUP BY ALL)
SELECT arm, count(*) AS seeds, sum(p)::DOUBLE / sum(n) AS acc, round(stddev_samp(p), 9) AS sd, min(p) AS fewest,
  max(p) AS most FROM s GROUP BY arm""",
)
def ab_seed_noise(t):
    return ab.seed_noise(episodes(t))


@query(
    "ab_power",
    f"""WITH {BOOT_SQL}, q AS (SELECT stddev_samp(v) AS sd, avg(v) AS centre FROM rep)
SELECT round(any_value(sd), 9) AS sd, round(2.8 * any_value(sd), 9) AS mde,
  count(*) FILTER (v - centre + 2 > 1.96 * sd)::DOUBLE / count(*) AS power FROM rep, q""",
)
def ab_power(t):
    return ab.power(ab.replicates(clusters(t), BOOT, SALT), margin=2.0)


SEEDS, ATTEMPT_BOOT = ((3, 3), (8, 5), (8, 8)), 100


def uniform_sql(*keys):
    return f"{sql_ticket(*keys)} / 4294967296.0::DOUBLE"


def reached_sql(u, steps):
    return f"len(list_filter({steps}, lambda q: q <= {u}))"


def steps_sql(size, p):
    """Cumulative probabilities of 0 to size - 1 passes of ``size`` attempts at the rate ``p``."""
    terms = [f"exp(lgamma({size} + 1) - lgamma({i} + 1) - lgamma({size - i} + 1) + {i} * ln({p}) + {size - i} * ln(1 - {p}))" for i in range(size)]
    sums = ", ".join(" + ".join(terms[: i + 1]) for i in range(size))
    return f"CASE WHEN {p} <= 0 THEN list_transform(range({size}), lambda i: 1.0::DOUBLE) WHEN {p} >= 1 THEN list_transform(range({size}), lambda i: 0.0::DOUBLE) ELSE [{sums}] END"


POISSON_SQL = "[" + ", ".join(" + ".join(f"exp(-1.0::DOUBLE) / {math.factorial(j)}" for j in range(i + 1)) for i in range(12)) + "]"


def seeds_sql(treat, base):
    return f"""SELECT '{treat} x {base}' AS seeds, b,
  sum({reached_sql(uniform_sql(str(SALT), "'treat'", f"'{treat}'", "task", "r", "b"), "st")} / {treat}::DOUBLE
    - {reached_sql(uniform_sql(str(SALT), "'base'", f"'{base}'", "task", "r", "b"), "sb")} / {base}::DOUBLE) AS s, count(*) AS n
  FROM copied JOIN (SELECT task, {steps_sql(treat, "pt")} AS st, {steps_sql(base, "pb")} AS sb FROM r) USING (task) GROUP BY b"""


@query(
    "ab_attempt_power",
    f"""WITH {RATES_SQL}, cc AS (SELECT cluster, b, {reached_sql(uniform_sql(str(SALT), "'copies'", "cluster", "b"), POISSON_SQL)} AS times
  FROM cl, range({ATTEMPT_BOOT}) bb(b)),
copied AS (SELECT task, b, unnest(range(times)) AS r FROM r JOIN cc USING (cluster)),
sums AS ({" UNION ALL ".join(seeds_sql(*pair) for pair in SEEDS)}),
q AS (SELECT *, 100 * s / n AS v, stddev_samp(100 * s / n) OVER w AS sd, avg(100 * s / n) OVER w AS centre FROM sums WINDOW w AS (PARTITION BY seeds))
SELECT seeds, round(any_value(sd), 9) AS sd, round(2.8 * any_value(sd), 9) AS mde,
  count(*) FILTER (v - centre + 5 > 1.96 * sd)::DOUBLE / count(*) AS power FROM q GROUP BY seeds""",
)
def ab_attempt_power(t):
    return ab.attempt_power(rates(t), ATTEMPT_BOOT, SALT, 5.0, SEEDS)


@query(
    "ab_cluster_effect",
    f"""WITH {RATES_SQL}, p AS (SELECT cluster, count(*) AS n, avg(d) AS centre, sum(d) AS s FROM r GROUP BY cluster),
 g AS (SELECT avg(d) AS centre, var_samp(d) AS variance, count(*) AS m FROM r),
 a AS (SELECT sum(p.n * (p.centre - g.centre) * (p.centre - g.centre)) / (count(*) - 1) AS among, count(*) AS k,
   (any_value(m) - sum(p.n * p.n) / any_value(m)::DOUBLE) / (count(*) - 1) AS size FROM p, g),
 w AS (SELECT sum((r.d - p.centre) * (r.d - p.centre)) / (count(*) - count(DISTINCT cluster)) AS within FROM r JOIN p USING (cluster)),
 i AS (SELECT *, (among - within) / (among + (size - 1) * within) AS icc FROM a, w, g),
 f AS (SELECT *, 1 + (m / k::DOUBLE - 1) * icc AS design FROM i)
SELECT m AS tasks, k AS clusters, round(icc, 9) AS icc, round(design, 9) AS design_effect,
  round(280 * sqrt(greatest(design, 0) * variance / m), 9) AS mde FROM f""",
)
def ab_cluster_effect(t):
    return ab.cluster_effect(rates(t))


@query(
    "ab_holm",
    f"""WITH {RATES_SQL}, w AS (SELECT task_set, {WINS_SQL} FROM r GROUP BY task_set),
 p AS (SELECT task_set, round({MCNEMAR_SQL}, 9) AS p FROM w),
 q AS (SELECT *, least(1.0::DOUBLE, ((SELECT count(*) FROM p) - row_number() OVER o + 1) * p) AS raw FROM p
  WINDOW o AS (ORDER BY p, task_set))
SELECT task_set, p, round(max(raw) OVER (ORDER BY p, task_set ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM q""",
)
def ab_holm(t):
    tests = ab.mcnemar(ab.wins_losses(rates(t), ["task_set"])).select("task_set", F.round("p", 9).alias("p"))
    return ab.holm(tests, "task_set").withColumn("p_holm", F.round("p_holm", 9))


# ---------------------------------------------------------------- group-relative scores


def attempts(t):
    return grp.scored(episodes(t), target=6000, alpha=0.1, no_submit=-1.0)


def nation_groups(t):
    keyed = attempts(t).select(
        c("cluster").alias("task"), c("month_no").alias("step"), "passed", "submitted", "reward", "outcome"
    )
    return grp.group_stats(keyed, ["task", "step"])


def customer_groups(t):
    keyed = attempts(t).select("task", c("quarter_no").alias("step"), "passed", "submitted", "reward", "outcome")
    return grp.group_stats(keyed, ["task", "step"])


@query("grp_shaped_reward", f"WITH {ATTEMPTS_SQL} SELECT episode, round(reward, 9) AS reward FROM x")
def grp_shaped_reward(t):
    return attempts(t).select("episode", F.round("reward", 9).alias("reward"))


@query(
    "grp_outcome_class",
    f"WITH {ATTEMPTS_SQL} SELECT month_no, outcome, count(*) AS n FROM x GROUP BY ALL",
)
def grp_outcome_class(t):
    return attempts(t).groupBy("month_no", "outcome").agg(F.count("*").alias("n"))


@query(
    "grp_drop_flat",
    f"WITH {group_sql('task', 'quarter_no')} SELECT task, step, n FROM g WHERE NOT flat",
)
def grp_drop_flat(t):
    return customer_groups(t).where(~c("flat")).select("task", "step", "n")


@query(
    "grp_advantage",
    f"""WITH {group_sql("cluster", "month_no")} SELECT episode, round((reward - mu) / sd, 7) AS advantage
FROM x JOIN g ON g.task = x.cluster AND g.step = x.month_no WHERE NOT flat""",
)
def grp_advantage(t):
    scored = grp.group_advantages(attempts(t), ["cluster", "month_no"])
    return scored.select("episode", F.round("advantage", 7).alias("advantage"))


@query(
    "grp_signal_kind",
    f"""WITH {group_sql("task", "quarter_no")} SELECT step, CASE WHEN flat THEN 'flat'
  WHEN passes > 0 AND passes < n THEN 'pass contrast' ELSE 'submit contrast' END AS kind, count(*) AS groups
FROM g GROUP BY ALL""",
)
def grp_signal_kind(t):
    return customer_groups(t).groupBy("step", grp.signal_kind().alias("kind")).agg(F.count("*").alias("groups"))


@query(
    "rest_streak",
    f"""WITH {group_sql("task", "quarter_no")}, i AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END)
  OVER (PARTITION BY task ORDER BY step) AS island FROM g)
SELECT task, step, flat, CAST(sum(CASE WHEN flat THEN 1 ELSE 0 END) OVER (PARTITION BY task, island ORDER BY step)
  AS INTEGER) AS streak FROM i""",
)
def rest_streak(t):
    return grp.flat_streaks(customer_groups(t).select("task", "step", "flat"))


@query(
    "rest_pool",
    f"""WITH RECURSIVE {group_sql("task", "quarter_no")}, h AS MATERIALIZED (SELECT task, step, flat FROM g),
walk(step, task, streak, rested_at, over, ended) AS (
  SELECT (SELECT min(step) FROM h) - 1, task, 0, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM h GROUP BY task
  UNION ALL
  SELECT now, task, streak2, CASE WHEN NOT active THEN rested_at WHEN flat AND streak2 >= 2 THEN now END,
    CASE WHEN active THEN rested_at END, CASE WHEN active AND rested_at IS NOT NULL THEN now END
  FROM (SELECT a.*, CASE WHEN NOT active OR flat IS NULL THEN streak1 WHEN flat THEN streak1 + 1 ELSE 0 END AS streak2
    FROM (SELECT b.*, h.flat, NOT resting OR all_back AS active
      FROM (SELECT *, count(*) FILTER (NOT resting) OVER () < (SELECT count(*) // 2 FROM customer) AS all_back
        FROM (SELECT step + 1 AS now, task, rested_at, coalesce(rested_at + 8 > step + 1, false) AS resting,
            CASE WHEN rested_at + 8 <= step + 1 THEN 0 ELSE streak END AS streak1
          FROM walk WHERE step < (SELECT max(step) FROM h))) b
      LEFT JOIN h ON h.task = b.task AND h.step = now) a))
SELECT task, over::INTEGER AS rested, ended::INTEGER AS back FROM walk WHERE over IS NOT NULL
UNION ALL
SELECT task, rested_at::INTEGER, rested_at::INTEGER + 8 FROM walk
WHERE rested_at IS NOT NULL AND step = (SELECT max(step) FROM h)""",
)
def rest_pool(t):
    groups = customer_groups(t).select("task", "step", "flat")
    pool = t.customer.count()
    rests, _ = grp.rest_pool(groups, drop_after=2, readmit_after=8, needed=pool // 2)
    return rests


@query(
    "rest_remeasure",
    f"""WITH {group_sql("task", "quarter_no")} SELECT task, step, sum(passes) OVER w::DOUBLE / sum(n) OVER w AS recent
FROM g WINDOW w AS (PARTITION BY task ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def rest_remeasure(t):
    return grp.recent_rate(customer_groups(t), 5).select("task", "step", "recent")


@query(
    "rest_sample",
    f"""WITH {group_sql("task", "quarter_no")}, k AS (SELECT task, step, row_number() OVER (PARTITION BY step
  ORDER BY {sql_ticket("7", "step", "task")}, task) - 1 AS k FROM g)
SELECT step, task, CAST(k AS INTEGER) AS k, CAST(7000000 + step * 1000 + k * 8 AS BIGINT) AS first_seed FROM k
WHERE k < 8""",
)
def rest_sample(t):
    tasks = customer_groups(t).select("task", "step")
    return grp.sample_active(tasks, 8, SALT, 8).select("step", "task", "k", "first_seed")
