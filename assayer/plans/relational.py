"""Filters, joins, aggregates, windows, set operations and scalar functions on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.functions.draws import draw, sql_ticket
from assayer.functions.numeric import day, mean, revenue, share, total, year
from assayer.operators import sketches
from assayer.operators.sessions import micros, session_slots, sessions, slot_of
from assayer.operators.trees import top_ancestors
from assayer.registry import query

c = F.col

# ---------------------------------------------------------------- filter, projection


@query("f_eq_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def f_eq_count(t):
    return t.orders.where(c("o_orderstatus") == "F").agg(F.count("*").alias("n"))


@query(
    "f_is_null",
    """
SELECT l_returnflag, count(closed_on) AS n_closed, count(*) - count(closed_on) AS n_open
FROM (SELECT l_returnflag, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS closed_on FROM lineitem)
GROUP BY l_returnflag""",
)
def f_is_null(t):
    lines = t.lineitem.select("l_returnflag", F.when(c("l_linestatus") == "F", c("l_shipdate")).alias("closed_on"))
    return lines.groupBy("l_returnflag").agg(
        F.count_if(c("closed_on").isNotNull()).alias("n_closed"), F.count_if(c("closed_on").isNull()).alias("n_open")
    )


@query(
    "f_between_in",
    """
SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
  AND l_discount BETWEEN 0.05 AND 0.07 AND l_linenumber IN (1, 3, 5) GROUP BY l_returnflag""",
)
def f_between_in(t):
    picked = t.lineitem.where(
        (c("l_shipdate") >= day("1996-01-01"))
        & (c("l_shipdate") < day("1997-01-01"))
        & c("l_discount").between(0.05, 0.07)
        & c("l_linenumber").isin(1, 3, 5)
    )
    return picked.groupBy("l_returnflag").agg(F.count("*").alias("n"), total("l_extendedprice").alias("price"))


@query(
    "f_like",
    """
SELECT p_type, count(*) FILTER (p_name LIKE 'red%') AS prefix, count(*) FILTER (p_name LIKE '%ring') AS suffix,
  count(*) FILTER (p_name LIKE '%e w%') AS inside, count(*) FILTER (p_name LIKE '%l%g%') AS two_words,
  count(*) FILTER (p_name NOT LIKE '%bolt%') AS without
FROM part GROUP BY p_type""",
)
def f_like(t):
    name = c("p_name")
    return t.part.groupBy("p_type").agg(
        F.count_if(name.startswith("red")).alias("prefix"),
        F.count_if(name.endswith("ring")).alias("suffix"),
        F.count_if(name.contains("e w")).alias("inside"),
        F.count_if(name.like("%l%g%")).alias("two_words"),
        F.count_if(~name.contains("bolt")).alias("without"),
    )


@query(
    "f_or_profiles",
    """
SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS value
FROM orders JOIN customer ON c_custkey = o_custkey
WHERE (c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT' AND o_totalprice BETWEEN 100000 AND 200000)
   OR (c_mktsegment = 'MACHINERY' AND o_orderpriority = '2-HIGH' AND o_totalprice BETWEEN 50000 AND 150000)
   OR (c_mktsegment = 'FURNITURE' AND o_orderpriority = '5-LOW' AND o_totalprice BETWEEN 150000 AND 300000)
GROUP BY c_mktsegment""",
)
def f_or_profiles(t):
    def profile(segment, priority, low, high):
        return (
            (c("c_mktsegment") == segment)
            & (c("o_orderpriority") == priority)
            & c("o_totalprice").between(low, high)
        )

    joined = t.orders.join(t.customer, c("c_custkey") == c("o_custkey"))
    wanted = joined.where(
        profile("BUILDING", "1-URGENT", 100000, 200000)
        | profile("MACHINERY", "2-HIGH", 50000, 150000)
        | profile("FURNITURE", "5-LOW", 150000, 300000)
    )
    return wanted.groupBy("c_mktsegment").agg(F.count("*").alias("n"), total("o_totalprice").alias("value"))


@query(
    "p_case_flag",
    """
SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS filled,
  count(CASE WHEN o_totalprice > 250000 THEN 1 END) AS large
FROM orders GROUP BY o_orderpriority""",
)
def p_case_flag(t):
    return t.orders.groupBy("o_orderpriority").agg(
        F.sum(F.when(c("o_orderstatus") == "F", 1).otherwise(0)).alias("filled"),
        F.count_if(c("o_totalprice") > 250000).alias("large"),
    )


@query(
    "p_coalesce_zero",
    """
SELECT s_suppkey, coalesce(r.value, 0) AS returned FROM supplier LEFT JOIN
 (SELECT l_suppkey, round(sum(l_extendedprice), 2) AS value FROM lineitem
  WHERE l_returnflag = 'R' AND l_quantity = 50 GROUP BY l_suppkey) r ON r.l_suppkey = s_suppkey""",
)
def p_coalesce_zero(t):
    returned = (
        t.lineitem.where((c("l_returnflag") == "R") & (c("l_quantity") == 50))
        .groupBy(c("l_suppkey").alias("s_suppkey"))
        .agg(total("l_extendedprice").alias("value"))
    )
    return t.supplier.join(returned, "s_suppkey", "left").select(
        "s_suppkey", F.coalesce("value", F.lit(0.0)).alias("returned")
    )


@query(
    "p_arith",
    """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
  round(sum(l_extendedprice), 2) / round(sum(l_quantity), 2) AS unit_price,
  100 * CAST(count(CASE WHEN l_discount > 0.05 THEN 1 END) AS DOUBLE) / count(*) AS pct_discounted
FROM lineitem GROUP BY ALL""",
)
def p_arith(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        total(revenue(), 4).alias("revenue"),
        F.try_divide(total("l_extendedprice"), total("l_quantity")).alias("unit_price"),
        share(F.count_if(c("l_discount") > 0.05), F.count("*")).alias("pct_discounted"),
    )


@query(
    "p_values_unnest",
    """
WITH names(status, label) AS (SELECT 'F', 'filled' UNION ALL SELECT 'O', 'open' UNION ALL SELECT 'P', 'part')
SELECT label, count(*) AS n FROM orders JOIN names ON status = o_orderstatus GROUP BY label""",
)
def p_values_unnest(t):
    names = t.spark.createDataFrame([("F", "filled"), ("O", "open"), ("P", "part")], "status STRING, label STRING")
    counts = t.orders.groupBy(c("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return counts.join(names, "status").select("label", "n")


# ---------------------------------------------------------------- joins


@query(
    "j_inner_equi",
    """
SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""",
)
def j_inner_equi(t):
    return (
        t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
        .join(t.customer, c("o_custkey") == c("c_custkey"))
        .join(t.nation, c("c_nationkey") == c("n_nationkey"))
        .join(t.region, c("n_regionkey") == c("r_regionkey"))
        .groupBy("r_name")
        .agg(F.count("*").alias("n"), total(revenue(), 4).alias("revenue"))
    )


@query(
    "j_left_zero",
    """
SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def j_left_zero(t):
    placed = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(placed, "c_custkey", "left").fillna(0, ["n"])


@query(
    "j_left_on_pred",
    """
SELECT c_nationkey, count(*) AS pairs, count(o_orderkey) AS urgent FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
GROUP BY c_nationkey""",
)
def j_left_on_pred(t):
    wanted = (c("o_custkey") == c("c_custkey")) & (c("o_orderstatus") == "P") & (c("o_orderpriority") == "1-URGENT")
    return (
        t.customer.join(t.orders, wanted, "left")
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("pairs"), F.count("o_orderkey").alias("urgent"))
    )


@query(
    "j_self",
    """
SELECT m.c_custkey AS manager, m.c_name AS name, count(*) AS reports
FROM customer e JOIN customer m ON m.c_custkey = e.c_custkey // 10
WHERE e.c_mktsegment <> m.c_mktsegment GROUP BY ALL""",
)
def j_self(t):
    e, m = t.customer.alias("e"), t.customer.alias("m")
    under = (F.floor(c("e.c_custkey") / 10) == c("m.c_custkey")) & (c("e.c_mktsegment") != c("m.c_mktsegment"))
    return (
        e.join(m, under)
        .groupBy(c("m.c_custkey").alias("manager"), c("m.c_name").alias("name"))
        .agg(F.count("*").alias("reports"))
    )


@query(
    "j_semi",
    """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50 AND l_returnflag = 'R')
GROUP BY o_orderpriority""",
)
def j_semi(t):
    full = t.lineitem.where((c("l_quantity") == 50) & (c("l_returnflag") == "R"))
    kept = t.orders.join(full, c("l_orderkey") == c("o_orderkey"), "left_semi")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "j_anti",
    """
SELECT c_mktsegment, count(*) AS n FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01')
GROUP BY c_mktsegment""",
)
def j_anti(t):
    recent = t.orders.where(c("o_orderdate") >= day("2000-06-01"))
    idle = t.customer.join(recent, c("o_custkey") == c("c_custkey"), "left_anti")
    return idle.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(
    "j_theta",
    """
SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
 AND l_shipdate > o_orderdate + INTERVAL 60 DAY AND l_extendedprice > 0.3 * o_totalprice GROUP BY o_orderpriority""",
)
def j_theta(t):
    late_and_large = (
        (c("l_orderkey") == c("o_orderkey"))
        & (c("l_shipdate") > c("o_orderdate") + F.expr("INTERVAL 60 DAY"))
        & (c("l_extendedprice") > 0.3 * c("o_totalprice"))
    )
    return t.lineitem.join(t.orders, late_and_large).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "j_scalar_threshold",
    """
WITH m AS (SELECT l_partkey, round(sum(l_quantity), 2) / count(*) AS q FROM lineitem GROUP BY l_partkey),
 d AS (SELECT round(sum(o_totalprice), 2) / count(*) AS v FROM orders)
SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS price
FROM lineitem l JOIN m ON m.l_partkey = l.l_partkey JOIN orders ON o_orderkey = l_orderkey, d
WHERE l_quantity < 0.2 * q AND o_totalprice > v""",
)
def j_scalar_threshold(t):
    typical = t.lineitem.groupBy("l_partkey").agg(mean("l_quantity").alias("q"))
    mean_value = t.orders.agg(mean("o_totalprice").alias("v")).scalar()
    large = t.orders.where(c("o_totalprice") > mean_value)
    return (
        t.lineitem.join(typical, "l_partkey")
        .where(c("l_quantity") < 0.2 * c("q"))
        .join(large, c("l_orderkey") == c("o_orderkey"), "left_semi")
        .agg(F.count("*").alias("n"), total("l_extendedprice").alias("price"))
    )


@query(
    "j_full_outer",
    """
WITH g AS (SELECT l_partkey, l_suppkey, l_returnflag AS flag, l_extendedprice AS p FROM lineitem),
 a AS (SELECT l_partkey, l_suppkey, round(sum(p), 2) AS accepted FROM g WHERE flag = 'A' GROUP BY ALL),
 r AS (SELECT l_partkey, l_suppkey, round(sum(p), 2) AS returned FROM g WHERE flag = 'R' GROUP BY ALL)
SELECT l_partkey, l_suppkey, accepted, returned FROM a FULL JOIN r USING (l_partkey, l_suppkey)""",
)
def j_full_outer(t):
    # a part and supplier may have lines with either flag only
    keys = ["l_partkey", "l_suppkey"]

    def side(flag, name):
        return t.lineitem.where(c("l_returnflag") == flag).groupBy(*keys).agg(total("l_extendedprice").alias(name))

    return side("A", "accepted").join(side("R", "returned"), keys, "full")


@query(
    "j_cross",
    """
WITH a AS (SELECT n_regionkey, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey
  GROUP BY n_regionkey), b AS (SELECT l_returnflag, count(*) AS lines FROM lineitem GROUP BY l_returnflag)
SELECT n_regionkey, l_returnflag, customers, lines FROM a CROSS JOIN b""",
)
def j_cross(t):
    regions = (
        t.customer.groupBy("c_nationkey")
        .agg(F.count("*").alias("k"))
        .join(t.nation, c("c_nationkey") == c("n_nationkey"))
        .groupBy("n_regionkey")
        .agg(F.sum("k").alias("customers"))
    )
    # an entry for each flag that occurs, few by nature: one list, unfolded beside each region
    counts = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("lines"))
    per_flag = counts.agg(F.collect_list(F.struct("l_returnflag", "lines")))
    return regions.select("n_regionkey", "customers", F.inline(per_flag.scalar()))


@query(
    "j_lag_key",
    """
WITH w AS (SELECT CAST(date_diff('week', DATE '1995-01-02', CAST(date_trunc('week', l_shipdate) AS DATE)) AS INTEGER)
  AS wk, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1)
SELECT a.wk, a.v, b.v AS next_year, a.v / b.v AS ratio FROM w a JOIN w b ON b.wk = a.wk + 52""",
)
def j_lag_key(t):
    week = F.floor(F.date_diff(F.date_trunc("week", "l_shipdate"), day("1995-01-02")) / 7).cast("int")
    weekly = t.lineitem.groupBy(week.alias("wk")).agg(total("l_extendedprice").alias("v"))
    later = weekly.select((c("wk") - 52).alias("wk"), c("v").alias("next_year"))
    return weekly.join(later, "wk").select("wk", "v", "next_year", F.try_divide("v", "next_year").alias("ratio"))


@query(
    "j_chain_events",
    """
WITH s AS (SELECT o_custkey AS ck, l_partkey // 50 AS pg,
   min(l_shipdate) FILTER (l_returnflag = 'N') AS sold, min(l_shipdate) FILTER (l_returnflag = 'R') AS back,
   max(l_shipdate) FILTER (l_returnflag = 'A') AS again
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT pg, count(*) AS chains, CAST(sum(date_diff('day', CAST(sold AS DATE), CAST(again AS DATE))) AS BIGINT) AS days
FROM s WHERE back > sold AND again > back GROUP BY pg""",
)
def j_chain_events(t):
    def when_flag(flag):
        return F.when(c("l_returnflag") == flag, c("l_shipdate"))

    chains = (
        t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
        .groupBy("o_custkey", F.floor(c("l_partkey") / 50).alias("pg"))
        .agg(
            F.min(when_flag("N")).alias("sold"),
            F.min(when_flag("R")).alias("back"),
            F.max(when_flag("A")).alias("again"),
        )
        .where((c("back") > c("sold")) & (c("again") > c("back")))
    )
    return chains.groupBy("pg").agg(
        F.count("*").alias("chains"), F.sum(F.date_diff("again", "sold").cast("bigint")).alias("days")
    )


@query(
    "j_latest_as_of",
    """
SELECT o_custkey, o_orderkey AS last_order, o_totalprice AS last_value FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def j_latest_as_of(t):
    newest = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return (
        t.orders.groupBy("o_custkey")
        .agg(newest.alias("x"))
        .select("o_custkey", c("x.o_orderkey").alias("last_order"), c("x.o_totalprice").alias("last_value"))
    )


@query(
    "j_using",
    """
WITH k AS (SELECT c_custkey AS id, c_nationkey FROM customer), o AS (SELECT o_custkey AS id, count(*) AS n
  FROM orders GROUP BY 1) SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS orders FROM k JOIN o USING (id)
GROUP BY c_nationkey""",
)
def j_using(t):
    per_customer = t.orders.groupBy(c("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    customers = t.customer.select(c("c_custkey").alias("id"), "c_nationkey")
    return customers.join(per_customer, "id").groupBy("c_nationkey").agg(F.sum("n").alias("orders"))


# ---------------------------------------------------------------- aggregates


@query(
    "a_group_basic",
    """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total,
  round(sum(o_totalprice), 2) / count(*) AS mean, min(o_totalprice) AS lowest, max(o_totalprice) AS highest
FROM orders GROUP BY o_orderpriority""",
)
def a_group_basic(t):
    v = "o_totalprice"
    return t.orders.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), total(v).alias("total"), mean(v).alias("mean"),
        F.min(v).alias("lowest"), F.max(v).alias("highest"),
    )


@query(
    "a_count_distinct",
    """
SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts
FROM lineitem GROUP BY l_returnflag""",
)
def a_count_distinct(t):
    # one narrow pass per counted column: distinct pairs first, so a hot flag never meets one task
    def distinct_of(column, name):
        pairs = t.lineitem.select("l_returnflag", column).distinct()
        return pairs.groupBy("l_returnflag").agg(F.count("*").alias(name))

    return distinct_of("l_suppkey", "suppliers").join(distinct_of("l_partkey", "parts"), "l_returnflag")


@query(
    "a_count_distinct_approx",
    """
SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, true AS within
FROM lineitem GROUP BY l_returnflag""",
)
def a_count_distinct_approx(t):
    # the sketch's stated error is a standard deviation: four of them are the bound that it is held to
    error, flag = 0.02, "l_returnflag"
    # apart from the exact counts, which would keep two sketches beside every distinct value
    sketched = t.lineitem.groupBy(c(flag).alias("flag")).agg(
        F.approx_count_distinct("l_suppkey", error).alias("s"), F.approx_count_distinct("l_partkey", error).alias("p")
    )

    def distinct_of(column, name):
        pairs = t.lineitem.select(flag, column).distinct()
        return pairs.groupBy(c(flag).alias(f"{name}_flag")).agg(F.count(column).alias(name))

    counted = sketched
    for found, name in ((distinct_of("l_suppkey", "suppliers"), "suppliers"), (distinct_of("l_partkey", "parts"), "parts")):
        counted = counted.join(found, c("flag").eqNullSafe(c(f"{name}_flag")))

    def near(sketch, exact):
        return F.abs(c(sketch) - c(exact)) <= 4 * error * c(exact) + 1

    within = near("s", "suppliers") & near("p", "parts")
    return counted.select(c("flag").alias(flag), "suppliers", "parts", within.alias("within"))


@query(
    "a_count_distinct_periods",
    """
SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(quarter(l_shipdate) AS INTEGER) AS qtr,
  count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, true AS within
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, year(l_shipdate), quarter(l_shipdate)), (l_returnflag, year(l_shipdate)), (l_returnflag))""",
)
def a_count_distinct_periods(t):
    counted = ["l_suppkey", "l_partkey"]
    lines = t.lineitem.withColumn("day", c("l_shipdate").cast("date"))
    daily = sketches.daily(lines, ["l_returnflag"], "day", counted)
    merged = sketches.merged(daily.withColumns({"yr": F.year("day"), "qtr": F.quarter("day")}), ["l_returnflag"], ["yr", "qtr"], counted)
    suppliers = sketches.exact(lines, "l_returnflag", "day", "l_suppkey", "suppliers").alias("s")
    parts = sketches.exact(lines, "l_returnflag", "day", "l_partkey", "parts").alias("p")
    periods = ["level", "l_returnflag", "yr", "qtr"]
    both = suppliers.join(parts, [c(f"s.{k}").eqNullSafe(c(f"p.{k}")) for k in periods])
    exact = both.select("s.l_returnflag", "s.yr", "s.qtr", "suppliers", "parts")
    same = [exact[k].eqNullSafe(merged[k]) for k in ("l_returnflag", "yr", "qtr")]
    within = sketches.near("l_suppkey", "suppliers") & sketches.near("l_partkey", "parts")
    return exact.join(merged, same).select(exact["l_returnflag"], exact["yr"], exact["qtr"], "suppliers", "parts", within.alias("within"))


@query(
    "a_having",
    """
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_custkey
HAVING count(*) >= 12 AND round(sum(o_totalprice), 2) > 3000000""",
)
def a_having(t):
    spend = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), total("o_totalprice").alias("v"))
    return spend.where((c("n") >= 12) & (c("v") > 3000000))


@query(
    "a_two_level",
    """
WITH u AS (SELECT c_nationkey, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders
  ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY ALL)
SELECT c_nationkey, CAST(sum(n) AS DOUBLE) / count(*) AS mean_orders, max(n) AS most FROM u GROUP BY c_nationkey""",
)
def a_two_level(t):
    filled = (
        t.orders.where(c("o_orderstatus") == "F")
        .groupBy(c("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n"))
    )
    per_customer = t.customer.select("c_custkey", "c_nationkey").join(filled, "c_custkey", "left").fillna(0, ["n"])
    return per_customer.groupBy("c_nationkey").agg(F.avg("n").alias("mean_orders"), F.max("n").alias("most"))


@query(
    "a_median",
    """
WITH k AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderpriority, median(n) AS med, max(n) AS most, avg(n) AS mean
FROM k JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
)
def a_median(t):
    sizes = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    # the median reads one weighted row per distinct size, not one per order
    weighted = sizes.join(t.orders, "o_orderkey").groupBy("o_orderpriority", "n").agg(F.count("*").alias("k"))
    return weighted.groupBy("o_orderpriority").agg(
        F.percentile("n", 0.5, c("k")).alias("med"),
        F.max("n").alias("most"),
        F.try_divide(F.sum(c("n") * c("k")).cast("double"), F.sum("k").cast("double")).alias("mean"),
    )


@query(
    "a_stddev_cv",
    """
SELECT l_suppkey, round(stddev_samp(l_quantity), 6) AS sd,
  round(stddev_samp(l_quantity) / nullif(avg(l_quantity), 0), 6) AS cv FROM lineitem GROUP BY l_suppkey""",
)
def a_stddev_cv(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"),
        F.round(F.try_divide(F.stddev_samp("l_quantity"), F.avg("l_quantity")), 6).alias("cv"),
    )


@query(
    "a_rollup",
    """
SELECT r_name, n_name, CAST(grouping(r_name) * 2 + grouping(n_name) AS BIGINT) AS level,
  count(*) AS n, round(sum(o_totalprice), 2) AS v
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""",
)
def a_rollup(t):
    # nation totals are formed before the rollup expands rows, so the expansion costs 3 x 25 rows
    by_nation = (
        t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
        .join(t.nation, c("c_nationkey") == c("n_nationkey"))
        .join(t.region, c("n_regionkey") == c("r_regionkey"))
    )
    return by_nation.rollup("r_name", "n_name").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"), total("v").alias("v")
    )


@query(
    "a_pivot_cond",
    """
SELECT l_returnflag, round(sum(p) FILTER (d = 0), 2) AS sun, round(sum(p) FILTER (d = 1), 2) AS mon,
  round(sum(p) FILTER (d = 2), 2) AS tue, round(sum(p) FILTER (d = 3), 2) AS wed, round(sum(p) FILTER (d = 4), 2) AS thu,
  round(sum(p) FILTER (d = 5), 2) AS fri, round(sum(p) FILTER (d = 6), 2) AS sat
FROM (SELECT l_returnflag, l_extendedprice AS p, dayofweek(l_shipdate) AS d FROM lineitem) GROUP BY l_returnflag""",
)
def a_pivot_cond(t):
    names = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
    weekday = F.element_at(F.array(*[F.lit(n) for n in names]), F.dayofweek("l_shipdate"))
    return (
        t.lineitem.withColumn("weekday", weekday)
        .groupBy("l_returnflag")
        .pivot("weekday", names)
        .agg(total("l_extendedprice"))
    )


@query(
    "a_threshold_pick",
    """
SELECT l_suppkey, CASE WHEN count(*) > 600 THEN round(sum(l_discount), 2) / count(*)
  ELSE round(sum(l_tax), 2) / count(*) END AS v FROM lineitem GROUP BY l_suppkey""",
)
def a_threshold_pick(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.when(F.count("*") > 600, mean("l_discount")).otherwise(mean("l_tax")).alias("v")
    )


@query(
    "a_nested_max_share",
    """
WITH s AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_custkey)
SELECT o_custkey, v FROM s WHERE v > 0.75 * (SELECT max(v) FROM s)""",
)
def a_nested_max_share(t):
    spend = t.orders.groupBy("o_custkey").agg(total("o_totalprice").alias("v"))
    return spend.where(c("v") > 0.75 * spend.agg(F.max("v")).scalar())


@query(
    "a_map_counter",
    """
SELECT c_nationkey, string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) AS counts FROM
 (SELECT c_nationkey, o_orderstatus, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
GROUP BY c_nationkey""",
)
def a_map_counter(t):
    counts = (
        t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
        .groupBy("c_nationkey", "o_orderstatus")
        .agg(F.count("*").alias("n"))
    )
    counter = F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))))
    shown = F.transform(F.map_entries("counter"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return (
        counts.groupBy("c_nationkey")
        .agg(counter.alias("counter"))
        .select("c_nationkey", F.array_join(shown, ",").alias("counts"))
    )


# ---------------------------------------------------------------- windows


@query(
    "w_first_per_key",
    """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER
 (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) = 1""",
)
def w_first_per_key(t):
    best = Window.partitionBy("l_suppkey").orderBy(
        F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"
    )
    # rn = 1 turns into a limit per map task before the shuffle
    ranked = t.lineitem.withColumn("rn", F.row_number().over(best)).where(c("rn") == 1)
    return ranked.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "w_nth_gap",
    """
WITH r AS (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  AS rn FROM orders WHERE o_orderstatus = 'F'),
 g AS (SELECT o_custkey, min(o_orderdate) FILTER (rn = 1) AS d1, min(o_orderdate) FILTER (rn = 3) AS d3 FROM r
  GROUP BY o_custkey)
SELECT count(*) AS n FROM g WHERE date_diff('day', CAST(d1 AS DATE), CAST(d3 AS DATE)) <= 365""",
)
def w_nth_gap(t):
    in_order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    early = (
        t.orders.where(c("o_orderstatus") == "F")
        .withColumn("rn", F.row_number().over(in_order))
        .where(c("rn") <= 3)
        .groupBy("o_custkey")
        .agg(
            F.min(F.when(c("rn") == 1, c("o_orderdate"))).alias("d1"),
            F.min(F.when(c("rn") == 3, c("o_orderdate"))).alias("d3"),
        )
    )
    return early.where(F.date_diff("d3", "d1") <= 365).agg(F.count("*").alias("n"))


@query(
    "w_both_ends",
    """
WITH r AS (SELECT o_custkey, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS down FROM orders)
SELECT o_custkey, max(o_totalprice) FILTER (down = 1) - max(o_totalprice) FILTER (up = 1) AS change
FROM r GROUP BY o_custkey""",
)
def w_both_ends(t):
    place = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(
        (F.max_by("o_totalprice", place) - F.min_by("o_totalprice", place)).alias("change")
    )


@query(
    "w_rank_in_parent",
    """
WITH g AS (SELECT p_type, p_brand, CAST(grouping(p_type) + grouping(p_brand) AS INTEGER) AS depth,
  round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN part ON p_partkey = l_partkey
  GROUP BY ROLLUP (p_type, p_brand))
SELECT p_type, p_brand, depth, v, CAST(rank() OVER (PARTITION BY depth, CASE WHEN depth = 0 THEN p_type END
  ORDER BY v DESC) AS INTEGER) AS place FROM g""",
)
def w_rank_in_parent(t):
    cells = (
        t.lineitem.groupBy("l_partkey")
        .agg(F.sum("l_extendedprice").alias("v"))
        .join(t.part, c("l_partkey") == c("p_partkey"))
        .groupBy("p_type", "p_brand")
        .agg(F.sum("v").alias("v"))
    )
    levels = cells.rollup("p_type", "p_brand").agg(
        (F.grouping("p_type") + F.grouping("p_brand")).cast("int").alias("depth"), total("v").alias("v")
    )
    parent = F.when(c("depth") == 0, c("p_type"))
    return levels.withColumn("place", F.rank().over(Window.partitionBy("depth", parent).orderBy(F.desc("v"))))


@query(
    "w_rank_top_k_group",
    """
WITH s AS (SELECT p_type, p_partkey, round(sum(l_quantity), 2) AS q FROM lineitem JOIN part ON p_partkey = l_partkey
  GROUP BY ALL)
SELECT p_type, p_partkey, q FROM s QUALIFY rank() OVER (PARTITION BY p_type ORDER BY q DESC) <= 10""",
)
def w_rank_top_k_group(t):
    sold = t.lineitem.groupBy(c("l_partkey").alias("p_partkey")).agg(total("l_quantity").alias("q"))
    typed = sold.join(t.part.select("p_partkey", "p_type"), "p_partkey")
    best = Window.partitionBy("p_type").orderBy(F.desc("q"))
    return typed.withColumn("r", F.rank().over(best)).where(c("r") <= 10).select("p_type", "p_partkey", "q")


@query(
    "w_share_of_total",
    """
WITH s AS (SELECT p_type, p_partkey, round(sum(l_extendedprice), 2) AS v FROM lineitem
  JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT p_partkey, v, v * 100 / round(sum(v) OVER (PARTITION BY p_type), 2) AS pct FROM s""",
)
def w_share_of_total(t):
    sold = t.lineitem.groupBy(c("l_partkey").alias("p_partkey")).agg(total("l_extendedprice").alias("v"))
    typed = sold.join(t.part.select("p_partkey", "p_type"), "p_partkey")
    # the class total is an aggregate joined back: a class may hold a third of all parts
    classes = typed.groupBy("p_type").agg(total("v").alias("class_v"))
    return typed.join(classes, "p_type").select("p_partkey", "v", F.try_divide(c("v") * 100, "class_v").alias("pct"))


@query(
    "w_dev_from_avg",
    """
WITH m AS (SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mo,
   round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON c_custkey = o_custkey
   JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
 a AS (SELECT *, round(sum(v) OVER (PARTITION BY n_name, yr), 2) / count(*) OVER (PARTITION BY n_name, yr) AS mean
   FROM m)
SELECT n_name, yr, mo, v, mean FROM a WHERE abs(v - mean) / mean > 0.1""",
)
def w_dev_from_avg(t):
    monthly = (
        t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
        .groupBy("c_nationkey", year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo"))
        .agg(total("o_totalprice").alias("v"))
        .join(t.nation, c("c_nationkey") == c("n_nationkey"))
    )
    w = Window.partitionBy("n_name", "yr")
    return (
        monthly.withColumn("mean", F.round(F.sum("v").over(w), 2) / F.count("*").over(w))
        .where(F.abs(c("v") - c("mean")) / c("mean") > 0.1)
        .select("n_name", "yr", "mo", "v", "mean")
    )


@query(
    "w_lag_lead",
    """
WITH m AS (SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS mo,
  round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY ALL)
SELECT l_returnflag, mo, v, lag(v) OVER w AS before, lead(v) OVER w AS after FROM m
WINDOW w AS (PARTITION BY l_returnflag ORDER BY mo)""",
)
def w_lag_lead(t):
    month = F.date_trunc("month", "l_shipdate").cast("date")
    monthly = t.lineitem.groupBy("l_returnflag", month.alias("mo")).agg(total("l_extendedprice").alias("v"))
    w = Window.partitionBy("l_returnflag").orderBy("mo")
    return monthly.select(
        "l_returnflag", "mo", "v", F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after")
    )


@query(
    "w_running_sum_max",
    """
WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS dt, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity
   ELSE l_quantity END) AS q FROM lineitem GROUP BY ALL),
 s AS (SELECT *, sum(q) OVER (PARTITION BY l_suppkey ORDER BY dt) AS so_far FROM d)
SELECT l_suppkey, dt, so_far, max(so_far) OVER (PARTITION BY l_suppkey ORDER BY dt) AS peak FROM s""",
)
def w_running_sum_max(t):
    signed = F.when(c("l_returnflag") == "R", -c("l_quantity")).otherwise(c("l_quantity"))
    # at most one row per supplier and day reaches the window
    daily = t.lineitem.groupBy("l_suppkey", c("l_shipdate").cast("date").alias("dt")).agg(F.sum(signed).alias("q"))
    w = Window.partitionBy("l_suppkey").orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        daily.withColumn("so_far", F.sum("q").over(w))
        .withColumn("peak", F.max("so_far").over(w))
        .select("l_suppkey", "dt", "so_far", "peak")
    )


SQL_SESSIONS = """
e AS (SELECT *, CASE WHEN lag(ts) OVER u IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER u) >= 1800000000 THEN 1 ELSE 0
  END AS opens FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM e)
"""


@query(
    "w_session_rank",
    f"""
WITH {SQL_SESSIONS}, p AS (SELECT user_id, min(session_no) AS k FROM s WHERE event_type = 'purchase' GROUP BY user_id)
SELECT count(*) AS buyers, count(*) FILTER (k > 1) AS later FROM p""",
)
def w_session_rank(t):
    bought = F.count_if(c("event_type") == "purchase").alias("purchases")
    slots = session_slots(t.events, "user_id", "ts", 1800, [bought])
    first = slots.where(c("purchases") > 0).groupBy("user_id").agg(F.min("session_no").alias("k"))
    return first.agg(F.count("*").alias("buyers"), F.count_if(c("k") > 1).alias("later"))


# ---------------------------------------------------------------- sort, sets, recursion


@query(
    "o_topk_tiebreak",
    """
SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_custkey
ORDER BY v DESC, o_custkey LIMIT 10""",
)
def o_topk_tiebreak(t):
    spend = t.orders.groupBy("o_custkey").agg(total("o_totalprice").alias("v"))
    return spend.orderBy(F.desc("v"), "o_custkey").limit(10)


@query(
    "o_nulls_first",
    """
SELECT c_custkey, urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS urgent FROM orders
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey
ORDER BY urgent ASC NULLS FIRST, c_custkey LIMIT 100""",
)
def o_nulls_first(t):
    urgent = (
        t.orders.where((c("o_orderpriority") == "1-URGENT") & (c("o_orderstatus") == "F"))
        .groupBy(c("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("urgent"))
    )
    return (
        t.customer.select("c_custkey")
        .join(urgent, "c_custkey", "left")
        .orderBy(F.asc_nulls_first("urgent"), "c_custkey")
        .limit(100)
    )


@query(
    "s_union_all",
    """
SELECT channel, count(*) AS n, round(sum(v), 2) AS v FROM
 (SELECT 'order' AS channel, o_totalprice AS v FROM orders UNION ALL
  SELECT 'line', l_extendedprice FROM lineitem UNION ALL SELECT 'event', value FROM events) GROUP BY channel""",
)
def s_union_all(t):
    def channel(df, name, value):
        part = df.agg(F.count("*").alias("n"), total(value).alias("v"))
        return part.select(F.lit(name).alias("channel"), "n", "v")

    return (
        channel(t.orders, "order", "o_totalprice")
        .unionByName(channel(t.lineitem, "line", "l_extendedprice"))
        .unionByName(channel(t.events, "event", "value"))
    )


@query(
    "s_union_distinct",
    """
SELECT o_custkey AS id FROM orders WHERE o_totalprice > 400000 UNION
SELECT c_custkey FROM customer WHERE c_acctbal > 9000""",
)
def s_union_distinct(t):
    big = t.orders.where(c("o_totalprice") > 400000).select(c("o_custkey").alias("id"))
    rich = t.customer.where(c("c_acctbal") > 9000).select(c("c_custkey").alias("id"))
    return big.union(rich).distinct()


@query(
    "s_intersect",
    """
SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40 INTERSECT
SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 40 INTERSECT
SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40""",
)
def s_intersect(t):
    def parts(flag):
        return t.lineitem.where((c("l_returnflag") == flag) & (c("l_quantity") > 40)).select("l_partkey").distinct()

    return parts("A").intersect(parts("N")).intersect(parts("R"))


@query(
    "s_except",
    """
SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' EXCEPT
SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'""",
)
def s_except(t):
    early = t.orders.where(c("o_orderdate") < day("1999-01-01")).select("o_custkey")
    late = t.orders.where(c("o_orderdate") >= day("2000-01-01")).select("o_custkey")
    return early.distinct().subtract(late.distinct())


@query(
    "r_tree_rollup",
    f"""
WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN
    {sql_ticket("'boss'", "c_custkey")} % c_custkey END AS parent_id FROM customer),
 d AS (SELECT id, id AS top_id FROM n WHERE parent_id = 0 UNION ALL
  SELECT n.id, d.top_id FROM n JOIN d ON n.parent_id = d.id)
SELECT top_id, count(o_orderkey) AS orders, count(DISTINCT id) AS members FROM d LEFT JOIN orders ON o_custkey = id
GROUP BY top_id""",
)
def r_tree_rollup(t):
    boss = F.when(c("c_custkey") > 0, draw(F.greatest(c("c_custkey"), F.lit(1)), "boss", c("c_custkey")))
    nodes = t.customer.select(c("c_custkey").alias("id"), boss.alias("parent_id")).withColumn(
        "is_top", F.coalesce(c("parent_id") == 0, F.lit(False))
    )
    per_node = t.orders.groupBy(c("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return (
        top_ancestors(nodes, [], "is_top")
        .join(per_node, "id", "left")
        .groupBy("top_id")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.count("*").alias("members"))
    )


# ---------------------------------------------------------------- scalar functions


@query(
    "fn_year_trunc",
    """
SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(date_trunc('month', o_orderdate) AS DATE) AS mo,
  count(DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE)) AS weeks, count(*) AS n FROM orders GROUP BY ALL""",
)
def fn_year_trunc(t):
    weekly = t.orders.groupBy(
        year("o_orderdate").alias("yr"),
        F.date_trunc("month", "o_orderdate").cast("date").alias("mo"),
        F.date_trunc("week", "o_orderdate").cast("date").alias("wk"),
    ).agg(F.count("*").alias("n"))
    return weekly.groupBy("yr", "mo").agg(F.count("wk").alias("weeks"), F.sum("n").alias("n"))


@query(
    "fn_date_diff",
    """
SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 0 AND 30 GROUP BY l_returnflag""",
)
def fn_date_diff(t):
    joined = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    soon = joined.where(F.date_diff("l_shipdate", "o_orderdate").between(0, 30))
    return soon.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "fn_epoch_minutes",
    f"""
WITH {SQL_SESSIONS}, z AS (SELECT user_id, session_no, epoch_us(max(ts)) - epoch_us(min(ts)) AS us, count(*) AS n
  FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events,
  CAST(sum(us) AS DOUBLE) / 60000000 / count(*) AS mean_minutes FROM z GROUP BY user_id""",
)
def fn_epoch_minutes(t):
    closed = sessions(t.events, "user_id", "ts", 1800)
    spent = F.sum(micros("ended_at") - micros("started_at")).cast("double")
    return closed.groupBy("user_id").agg(
        F.count("*").alias("sessions"),
        F.sum("n_events").alias("events"),
        (spent / 60000000 / F.count("*")).alias("mean_minutes"),
    )


@query(
    "fn_round_half",
    """
SELECT l_quantity, round(l_quantity / 8, 2) AS away, round_even(l_quantity / 8, 2) AS even, count(*) AS n
FROM lineitem GROUP BY l_quantity""",
)
def fn_round_half(t):
    counts = t.lineitem.groupBy("l_quantity").agg(F.count("*").alias("n"))
    eighth = c("l_quantity") / 8
    return counts.select("l_quantity", F.round(eighth, 2).alias("away"), F.bround(eighth, 2).alias("even"), "n")


@query(
    "fn_substr_case",
    """
SELECT lower(substr(p_name, 1, 3)) || '-' || upper(coalesce(nullif(p_type, 'SMALL'), '')) AS code, count(*) AS n
FROM part GROUP BY 1""",
)
def fn_substr_case(t):
    kind = F.coalesce(F.nullif(c("p_type"), F.lit("SMALL")), F.lit(""))
    code = F.concat(F.lower(F.substring("p_name", 1, 3)), F.lit("-"), F.upper(kind))
    return t.part.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query(
    "fn_show_literal",
    r"""
WITH lit AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'CAST(''' || strftime(o_orderdate, '%Y-%m-%d') || ''' AS date)'
  WHEN o_orderkey % 3 = 1 THEN 'date ''' || strftime(o_orderdate, '%Y-%m-%d') || ''''
  ELSE '''' || o_orderpriority || '''' END AS v FROM orders)
SELECT coalesce(nullif(regexp_extract(v, '(?:CAST\(|date )''([0-9-]+)''', 1), ''), trim(v, '''')) AS shown,
  count(*) AS n FROM lit GROUP BY 1""",
)
def fn_show_literal(t):
    from assayer.functions.sqltext import show_literal

    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = c("o_orderkey") % 3
    literal = (
        F.when(kind == 0, F.concat(F.lit("CAST('"), text, F.lit("' AS date)")))
        .when(kind == 1, F.concat(F.lit("date '"), text, F.lit("'")))
        .otherwise(F.concat(F.lit("'"), c("o_orderpriority"), F.lit("'")))
    )
    return t.orders.groupBy(show_literal(literal).alias("shown")).agg(F.count("*").alias("n"))


@query(
    "fn_ws_collapse",
    r"""
SELECT source, CAST(sum(length(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))) AS BIGINT) AS chars,
  count(DISTINCT md5(rtrim(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')), ';'))) AS texts
FROM documents GROUP BY source""",
)
def fn_ws_collapse(t):
    from assayer.functions.sqltext import collapse

    flat = F.regexp_replace("text", r"[ \t\r\n\f]+", " ")
    per_text = (
        t.documents.select("source", F.length(flat).alias("chars"), F.md5(collapse(c("text"))).alias("key"))
        .groupBy("source", "key")
        .agg(F.sum(c("chars").cast("bigint")).alias("chars"))
    )
    return per_text.groupBy("source").agg(F.sum("chars").alias("chars"), F.count("key").alias("texts"))


@query(
    "fn_json",
    """
WITH p AS (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN substr(props, 1, 4) ELSE props END AS j FROM events)
SELECT event_type, count(k) AS good, count(*) - count(k) AS bad, CAST(sum(k) AS BIGINT) AS total FROM
 (SELECT event_type, CASE WHEN json_valid(j) THEN CAST(json_extract(j, '$.k') AS BIGINT) END AS k FROM p)
GROUP BY event_type""",
)
def fn_json(t):
    text = F.when(c("event_id") % 10 == 0, F.substring("props", 1, 4)).otherwise(c("props"))
    # a broken record reads as an empty map
    parsed = F.coalesce(F.from_json(text, "map<string,bigint>"), F.expr("map()").cast("map<string,bigint>"))
    k = F.try_element_at(parsed, F.lit("k"))
    return (
        t.events.select("event_type", k.alias("k"))
        .groupBy("event_type")
        .agg(
            F.count("k").alias("good"), F.count_if(c("k").isNull()).alias("bad"), F.sum("k").alias("total")
        )
    )


@query(
    "fn_num_string_eq",
    """
WITH v AS (SELECT l_returnflag, l_extendedprice AS a, CASE l_linenumber % 4 WHEN 0 THEN CAST(l_extendedprice AS VARCHAR)
   WHEN 1 THEN CAST(round(l_extendedprice) AS VARCHAR) WHEN 2 THEN 'x' || CAST(l_extendedprice AS VARCHAR)
   ELSE CAST(l_extendedprice + 0.004 AS VARCHAR) END AS b FROM lineitem),
 w AS (SELECT *, TRY_CAST(b AS DOUBLE) AS y FROM v)
SELECT l_returnflag, count(*) FILTER (y IS NOT NULL AND abs(a - y) <= greatest(1e-9 * greatest(abs(a), abs(y)), 0.01))
  AS same, count(*) AS n FROM w GROUP BY l_returnflag""",
)
def fn_num_string_eq(t):
    from assayer.functions.cells import number_of, numbers_close

    price = c("l_extendedprice")
    shape = c("l_linenumber") % 4
    text = (
        F.when(shape == 0, price.cast("string"))
        .when(shape == 1, F.round(price).cast("string"))
        .when(shape == 2, F.concat(F.lit("x"), price.cast("string")))
        .otherwise((price + 0.004).cast("string"))
    )
    same = F.coalesce(numbers_close(price, number_of(text)), F.lit(False))
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(same).alias("same"), F.count("*").alias("n"))



