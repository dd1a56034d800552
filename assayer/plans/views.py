"""Views the evaluation queries read, derived from the given tables, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

# ---------------------------------------------------------------- episodes: one order = one attempt

EPISODES_SQL = """
e AS (SELECT o_orderkey AS episode, CASE WHEN o_orderkey % 2 = 0 THEN 'treat' ELSE 'base' END AS arm, o_custkey AS task,
  c_nationkey AS cluster, c_mktsegment AS task_set, CAST(1 + (o_orderkey // 2) % 8 AS INTEGER) AS seed,
  CAST(1 + o_custkey % 4 AS INTEGER) AS hops, o_orderstatus = 'F' AS passed, o_orderstatus <> 'P' AS submitted,
  CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'text' ELSE 'tool' END
    WHEN o_orderkey % 3 = 1 THEN 'error' WHEN o_orderkey % 3 = 2 THEN 'malformed' END AS via,
  o_orderstatus = 'P' AND o_orderkey % 4 < 2 AS hit_cap,
  CASE o_orderstatus WHEN 'P' THEN 'NOSUBMIT' WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 1 THEN 'G3' ELSE 'G4' END END AS gate,
  CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month_no,
  CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS quarter_no,
  CAST(floor(o_totalprice / 20) AS BIGINT) AS gen_chars,
  CASE WHEN o_orderstatus <> 'P' THEN CASE o_orderkey % 4
    WHEN 0 THEN 'SELECT count(*) FROM orders WHERE o_custkey = ' || o_custkey
    WHEN 1 THEN 'SELECT c_name, sum(o_totalprice)  FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey = '
      || o_custkey || ' GROUP BY c_name;'
    WHEN 2 THEN 'WITH x AS (SELECT * FROM orders WHERE o_custkey = ' || o_custkey || ') SELECT max(o_orderdate) FROM x'
    ELSE 'SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) FROM orders WHERE o_totalprice > '
      || '(SELECT avg(o_totalprice) FROM orders) AND o_custkey = ' || o_custkey || ' AND o_orderkey <> ' || o_orderkey
    END END AS sql
  FROM orders JOIN customer ON c_custkey = o_custkey),
et AS (SELECT e.*, coalesce(k.n, 0) AS turns FROM e
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) k ON l_orderkey = episode)
"""


def episodes(t) -> DataFrame:
    key, status = c("o_orderkey"), c("o_orderstatus")
    joined = t.orders.join(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), c("o_custkey") == c("c_custkey"))
    task = c("o_custkey").cast("string")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("SELECT count(*) FROM orders WHERE o_custkey = "), task))
        .when(
            key % 4 == 1,
            F.concat(
                F.lit(
                    "SELECT c_name, sum(o_totalprice)  FROM customer JOIN orders ON o_custkey = c_custkey"
                    " WHERE c_custkey = "
                ),
                task,
                F.lit(" GROUP BY c_name;"),
            ),
        )
        .when(
            key % 4 == 2,
            F.concat(
                F.lit("WITH x AS (SELECT * FROM orders WHERE o_custkey = "),
                task,
                F.lit(") SELECT max(o_orderdate) FROM x"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit(
                    "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) FROM orders WHERE o_totalprice > "
                    "(SELECT avg(o_totalprice) FROM orders) AND o_custkey = "
                ),
                task,
                F.lit(" AND o_orderkey <> "),
                key.cast("string"),
            )
        )
    )
    submitted = status != "P"
    return joined.select(
        key.alias("episode"),
        F.when(key % 2 == 0, "treat").otherwise("base").alias("arm"),
        c("o_custkey").alias("task"),
        c("c_nationkey").alias("cluster"),
        c("c_mktsegment").alias("task_set"),
        (1 + F.floor(key / 2) % 8).cast("int").alias("seed"),
        (1 + c("o_custkey") % 4).cast("int").alias("hops"),
        (status == "F").alias("passed"),
        submitted.alias("submitted"),
        F.when(submitted, F.when(key % 5 == 0, "text").otherwise("tool"))
        .when(key % 3 == 1, "error")
        .when(key % 3 == 2, "malformed")
        .alias("via"),
        ((status == "P") & (key % 4 < 2)).alias("hit_cap"),
        F.when(status == "P", "NOSUBMIT")
        .when(status == "O", F.when(key % 4 == 1, "G3").otherwise("G4"))
        .alias("gate"),
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("int").alias("month_no"),
        ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1).cast("int").alias("quarter_no"),
        F.floor(c("o_totalprice") / 20).cast("bigint").alias("gen_chars"),
        F.when(submitted, text).alias("sql"),
    )


def episodes_with_turns(t) -> DataFrame:
    """Turns used = lines of the order."""
    lines = t.lineitem.groupBy(c("l_orderkey").alias("episode")).agg(F.count("*").alias("turns"))
    return episodes(t).join(lines, "episode", "left").fillna(0, ["turns"])


# ---------------------------------------------------------------- groups of attempts

ATTEMPTS_SQL = f"""{EPISODES_SQL},
w AS (SELECT *, CASE WHEN NOT submitted THEN -1.0::DOUBLE WHEN NOT passed THEN 0.0::DOUBLE
   WHEN gen_chars > 6000 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * ln(gen_chars::DOUBLE / 6000.0::DOUBLE))
   ELSE 1.0::DOUBLE END AS reward FROM e),
x AS (SELECT *, CASE WHEN reward > 0 THEN 1.0::DOUBLE ELSE reward END AS outcome FROM w)
"""


def group_sql(task: str, step: str) -> str:
    """``g``: one row per (task, step) group."""
    return f"""{ATTEMPTS_SQL}, g AS (SELECT {task} AS task, {step} AS step, count(*) AS n, avg(reward) AS mu,
  stddev_pop(reward) AS sd, sum(reward) AS reward_sum, count(*) FILTER (passed) AS passes,
  count(*) FILTER (submitted AND NOT passed) AS wrong, count(*) FILTER (NOT submitted) AS silent,
  var_pop(outcome) < 1e-8 AS flat FROM x GROUP BY ALL)"""
