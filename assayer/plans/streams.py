"""Streaming queries on the events and on episode logs; the SQL states the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators.metrics import rate
from assayer.plans.evaluation import customer_groups
from assayer.plans.views import EPISODES_SQL, episodes, group_sql
from assayer.registry import ORACLES, query
from assayer.session import fresh_path, written
from assayer.sources.tables import SCHEMAS
from assayer.streaming import jobs

c = F.col
DELAY = "1 day"  # fixed value: how long rows are waited for


def event_stream(t):
    # the pattern finds the table whether it is one file or a folder of part files
    return jobs.timed(jobs.file_stream(t.spark, f"{t.sf_dir}/events.parquet*", SCHEMAS["events"]))


def wall(column: str):
    return c(column).cast("timestamp_ntz").alias(column)


@query(
    "st_tumbling",
    """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL""",
)
def st_tumbling(t):
    rows = jobs.latest(jobs.window_counts(event_stream(t), "1 hour"), ["start", "event_type"])
    return rows.select(wall("start"), "event_type", "n", F.round("value", 2).alias("value"))


@query(
    "st_sliding",
    """SELECT date_trunc('hour', ts) - to_hours(h) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value
FROM events, range(6) r(h) GROUP BY ALL""",
)
def st_sliding(t):
    rows = jobs.latest(jobs.window_counts(event_stream(t), "6 hours", "1 hour"), ["start", "event_type"])
    return rows.select(wall("start"), "event_type", "n", F.round("value", 2).alias("value"))


@query(
    "st_session",
    """
WITH e AS (SELECT *, CASE WHEN lag(ts) OVER u IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER u) >= 1800000000 THEN 1 ELSE 0
  END AS opens FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e),
 z AS (SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS closes_at, count(*) AS n FROM s
  GROUP BY user_id, k)
SELECT * FROM z WHERE closes_at <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def st_session(t):
    rows = jobs.appended(jobs.session_counts(event_stream(t), "30 minutes"))
    return rows.select("user_id", wall("started_at"), wall("closes_at"), "n")


@query(
    "st_episode_counts",
    f"""WITH {EPISODES_SQL} SELECT arm, task_set, count(*) AS n, count(*) FILTER (passed) AS passes FROM e GROUP BY ALL""",
)
def st_episode_counts(t):
    log = fresh_path(t.spark, "episode-log")
    episodes(t).select("arm", "task_set", "task", "seed", "passed").write.json(log)
    stream = jobs.file_stream(
        t.spark, log, "arm STRING, task_set STRING, task BIGINT, seed INT, passed BOOLEAN", fmt="json"
    )
    return jobs.latest(jobs.episode_counts(stream, "arm", "task_set"), ["arm", "task_set"])


@query("st_dedup_resume", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st_dedup_resume(t):
    log = fresh_path(t.spark, "resent")
    rows = t.events.select("event_id", "ts", "event_type")
    for part in ("first", "again"):
        rows.write.parquet(f"{log}/part={part}")
    stream = jobs.file_stream(t.spark, log, "event_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING")
    once = jobs.resent_once(stream, ["event_id"], "ts", DELAY)
    return jobs.appended(once).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "st_late_rows",
    """
WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS mark FROM events WHERE event_id % 3 = 0)
SELECT count(*) AS read, count(*) FILTER (event_id % 3 = 0 OR ts > mark) AS kept, count(*) FILTER (event_id % 3 <> 0 AND ts <= mark) AS late
FROM events, m""",
)
def st_late_rows(t):
    # a third of the events comes first, then some from the day before its end, then all others: of these, what lies a
    # day behind the first third is dropped, and counted
    log = fresh_path(t.spark, "arrivals")
    rows = t.events.select("event_id", "ts", "event_type")
    (end,) = rows.where("event_id % 3 = 0").agg(F.max("ts")).first()
    first = c("event_id") % 3 == 0
    second = (c("event_id") % 3 == 1) & (c("ts") > F.lit(end) - F.expr("INTERVAL 1 DAY")) & (c("ts") <= F.lit(end))
    folder = None
    for part in (first, ~first & second, ~first & ~second):
        rows.where(part).write.mode("append").parquet(log)
        stream = jobs.file_stream(t.spark, log, "event_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING")
        once = jobs.resent_once(stream, ["event_id"], "ts", DELAY)
        folder = jobs.run_available(once, "append", folder)
    counts = jobs.row_counts(t.spark, folder).agg(F.sum("read").alias("read"), F.sum("late").alias("late"))
    kept = jobs.written(t.spark, folder, once).agg(F.count("*")).scalar()
    return counts.select("read", kept.alias("kept"), "late")


@query("st_rest_pool", ORACLES["rest_pool"])
def st_rest_pool(t):
    log, folder = fresh_path(t.spark, "groups"), fresh_path(t.spark, "pool")
    groups = written(customer_groups(t).select("task", c("step").cast("int").alias("step"), "flat"))
    tasks = groups.select("task").distinct()
    pool = jobs.RestPool(tasks, folder, drop_after=2, readmit_after=8, needed=t.customer.count() // 2)
    low, high = groups.agg(F.min("step"), F.max("step")).first()
    for start in range(low, high + 1, 10):  # the stream stops and goes on
        groups.where(c("step").between(start, start + 9)).write.mode("append").parquet(log)
        pool.run_available(jobs.file_stream(t.spark, log, jobs.PENDING))
    return pool.finish()


@query(
    "st_rest_state",
    f"""WITH {group_sql("task", "quarter_no")}, i AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END)
  OVER (PARTITION BY task ORDER BY step) AS island FROM g)
SELECT task, step, flat, CAST(sum(CASE WHEN flat THEN 1 ELSE 0 END) OVER (PARTITION BY task, island ORDER BY step)
  AS INTEGER) AS streak FROM i""",
)
def st_rest_state(t):
    log = fresh_path(t.spark, "groups")
    customer_groups(t).select("task", c("step").cast("int").alias("step"), "flat").write.parquet(log)
    stream = jobs.file_stream(t.spark, log, "task BIGINT, step INT, flat BOOLEAN")
    return jobs.appended(jobs.rest_streaks(stream))


@query(
    "st_regression_alarm",
    f"""
WITH {EPISODES_SQL}, s AS (SELECT task_set, month_no AS step, count(*) FILTER (passed)::DOUBLE / count(*) AS acc
  FROM e GROUP BY ALL), b AS (SELECT task_set, acc AS base_acc FROM s WHERE step = 0)
SELECT task_set, step, acc, base_acc FROM s JOIN b USING (task_set) WHERE step >= 50 AND acc < base_acc - 0.10
QUALIFY row_number() OVER (PARTITION BY task_set ORDER BY step) = 1""",
)
def st_regression_alarm(t):
    log = fresh_path(t.spark, "scores")
    scores = episodes(t).groupBy("task_set", c("month_no").alias("step")).agg(rate(c("passed")).alias("acc"))
    scores.write.parquet(log)
    base = t.spark.read.parquet(log).where(c("step") == 0).select("task_set", c("acc").alias("base_acc"))
    stream = jobs.file_stream(t.spark, log, "task_set STRING, step INT, acc DOUBLE")
    return jobs.latest(jobs.regression_alarms(stream, base, ["task_set"], 50, 0.10), ["task_set"])
