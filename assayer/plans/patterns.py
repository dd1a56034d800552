"""Analytical patterns of retail questions, re-aimed at the given tables; the return flag is the channel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.functions.numeric import day, mean, revenue, total, year

from assayer.registry import query

c = F.col


def line_part():
    return c("l_partkey") == c("p_partkey")


def line_order():
    return c("l_orderkey") == c("o_orderkey")


@query(
    "ds_star_topn",
    """
SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, p_brand, round(sum(l_extendedprice), 2) AS v
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
WHERE month(o_orderdate) = 11 AND p_type = 'PROMO' GROUP BY ALL ORDER BY yr, v DESC, p_brand LIMIT 100""",
)
def ds_star_topn(t):
    return (
        t.lineitem.join(t.part.where(c("p_type") == "PROMO"), line_part())
        .join(t.orders.where(F.month("o_orderdate") == 11), line_order())
        .groupBy(year("o_orderdate").alias("yr"), "p_brand")
        .agg(total("l_extendedprice").alias("v"))
        .orderBy("yr", F.desc("v"), "p_brand")
        .limit(100)
    )


@query(
    "ds_or_profiles",
    """
SELECT count(*) AS n, sum(l_quantity) / count(*) AS avg_qty, round(sum(l_extendedprice), 2) / count(*) AS avg_price,
  round(sum(l_tax), 2) AS tax FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey
WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01'
 AND ((p_type = 'SMALL' AND l_quantity BETWEEN 10 AND 15) OR (p_type = 'LARGE' AND l_quantity BETWEEN 5 AND 10)
   OR (p_type = 'MEDIUM' AND l_quantity BETWEEN 15 AND 20))
 AND ((c_nationkey IN (1, 7) AND l_discount <= 0.04) OR (c_nationkey IN (3, 9, 12) AND l_discount BETWEEN 0.05 AND 0.08)
   OR (c_nationkey IN (2, 7, 20) AND l_discount > 0.06))""",
)
def ds_or_profiles(t):
    qty, discount, nation = c("l_quantity"), c("l_discount"), c("c_nationkey")
    goods = (
        ((c("p_type") == "SMALL") & qty.between(10, 15))
        | ((c("p_type") == "LARGE") & qty.between(5, 10))
        | ((c("p_type") == "MEDIUM") & qty.between(15, 20))
    )
    places = (
        (nation.isin(1, 7) & (discount <= 0.04))
        | (nation.isin(3, 9, 12) & discount.between(0.05, 0.08))
        | (nation.isin(2, 7, 20) & (discount > 0.06))
    )
    lines = t.lineitem.where((c("l_shipdate") >= day("1998-01-01")) & (c("l_shipdate") < day("1999-01-01")))
    # the keys stay outside the ORs, so every join is an equi-join
    return (
        lines.join(t.part, line_part())
        .where(goods)
        .join(t.orders, line_order())
        .join(t.customer, c("o_custkey") == c("c_custkey"))
        .where(places)
        .agg(
            F.count("*").alias("n"),
            mean("l_quantity").alias("avg_qty"),
            mean("l_extendedprice").alias("avg_price"),
            total("l_tax").alias("tax"),
        )
    )


@query(
    "ds_key_avg_threshold",
    """
WITH m AS (SELECT l_partkey AS k, round(sum(l_extendedprice), 2) / count(*) AS v FROM lineitem GROUP BY 1)
SELECT o_custkey, count(*) AS n, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN m ON k = l_partkey
JOIN orders ON o_orderkey = l_orderkey WHERE l_extendedprice > 1.3 * m.v AND l_returnflag = 'R' GROUP BY o_custkey
ORDER BY n DESC, v DESC, o_custkey LIMIT 100""",
)
def ds_key_avg_threshold(t):
    typical = t.lineitem.groupBy("l_partkey").agg(mean("l_extendedprice").alias("typical"))
    dear = t.lineitem.where(c("l_returnflag") == "R").join(typical, "l_partkey").where(
        c("l_extendedprice") > 1.3 * c("typical")
    )
    return (
        dear.join(t.orders, line_order())
        .groupBy("o_custkey")
        .agg(F.count("*").alias("n"), total("l_extendedprice").alias("v"))
        .orderBy(F.desc("n"), F.desc("v"), "o_custkey")
        .limit(100)
    )


@query(
    "ds_channel_union",
    """
WITH b AS (SELECT p_brand, l_returnflag, l_extendedprice AS v FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_shipdate >= DATE '1997-03-01' AND l_shipdate < DATE '1997-04-01'),
 u AS (SELECT 'accepted' AS channel, p_brand, sum(v) AS v FROM b WHERE l_returnflag = 'A' GROUP BY ALL
  UNION ALL SELECT 'new', p_brand, sum(v) FROM b WHERE l_returnflag = 'N' GROUP BY ALL
  UNION ALL SELECT 'returned', p_brand, sum(v) FROM b WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT p_brand, count(*) AS channels, round(sum(v), 2) AS v FROM u GROUP BY p_brand""",
)
def ds_channel_union(t):
    names = F.create_map(*[F.lit(x) for x in ("A", "accepted", "N", "new", "R", "returned")])
    lines = t.lineitem.where((c("l_shipdate") >= day("1997-03-01")) & (c("l_shipdate") < day("1997-04-01")))
    # the channels share a table, so they are stacked in one pass instead of three scans
    stacked = (
        lines.join(t.part, line_part())
        .groupBy(names[c("l_returnflag")].alias("channel"), "p_brand")
        .agg(F.sum("l_extendedprice").alias("v"))
    )
    return stacked.groupBy("p_brand").agg(F.count("channel").alias("channels"), total("v").alias("v"))


@query(
    "ds_rollup",
    """
WITH g AS (SELECT r_name, n_name, c_mktsegment, CAST(grouping(r_name) + grouping(n_name) + grouping(c_mktsegment)
   AS INTEGER) AS depth, round(sum(o_totalprice), 2) AS v, count(*) AS n
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment))
SELECT r_name, n_name, c_mktsegment, depth, n, v, CAST(rank() OVER (PARTITION BY depth, CASE WHEN depth < 2 THEN r_name END,
  CASE WHEN depth < 1 THEN n_name END ORDER BY v DESC) AS INTEGER) AS place FROM g""",
)
def ds_rollup(t):
    cells = (
        t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
        .groupBy("c_nationkey", "c_mktsegment")
        .agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
        .join(t.nation, c("c_nationkey") == c("n_nationkey"))
        .join(t.region, c("n_regionkey") == c("r_regionkey"))
    )
    depth = sum((F.grouping(x) for x in ("n_name", "c_mktsegment")), F.grouping("r_name")).cast("int")
    levels = cells.rollup("r_name", "n_name", "c_mktsegment").agg(
        depth.alias("depth"), F.sum("n").alias("n"), total("v").alias("v")
    )
    parent = [F.when(c("depth") < 2, c("r_name")), F.when(c("depth") < 1, c("n_name"))]
    return levels.withColumn("place", F.rank().over(Window.partitionBy("depth", *parent).orderBy(F.desc("v"))))


@query(
    "ds_growth_vs",
    """
WITH y AS (SELECT o_custkey, round(sum(l_extendedprice) FILTER (l_returnflag = 'R' AND year(l_shipdate) = 1997), 2) AS r1,
  round(sum(l_extendedprice) FILTER (l_returnflag = 'R' AND year(l_shipdate) = 1998), 2) AS r2,
  round(sum(l_extendedprice) FILTER (l_returnflag = 'A' AND year(l_shipdate) = 1997), 2) AS a1,
  round(sum(l_extendedprice) FILTER (l_returnflag = 'A' AND year(l_shipdate) = 1998), 2) AS a2
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey)
SELECT o_custkey, r2 / r1 AS returned_growth, a2 / a1 AS accepted_growth FROM y
WHERE r1 > 0 AND a1 > 0 AND r2 / r1 > a2 / a1""",
)
def ds_growth_vs(t):
    shipped = t.lineitem.where((c("l_shipdate") >= day("1997-01-01")) & (c("l_shipdate") < day("1999-01-01")))

    def sales(flag, yr):
        return total(F.when((c("l_returnflag") == flag) & (F.year("l_shipdate") == yr), c("l_extendedprice")))

    yearly = (
        shipped.where(c("l_returnflag").isin("A", "R"))
        .join(t.orders, line_order())
        .groupBy("o_custkey")
        .agg(
            F.try_divide(sales("R", 1998), sales("R", 1997)).alias("returned_growth"),
            F.try_divide(sales("A", 1998), sales("A", 1997)).alias("accepted_growth"),
        )
    )
    return yearly.where(c("returned_growth") > c("accepted_growth"))


@query(
    "ds_week_ratio",
    """
WITH w AS (SELECT CAST(date_diff('day', DATE '1995-01-02', CAST(date_trunc('week', l_shipdate) AS DATE)) // 7 AS INTEGER)
   AS wk, round(sum(l_extendedprice) FILTER (isodow(l_shipdate) = 1), 2) AS mon,
   round(sum(l_extendedprice) FILTER (isodow(l_shipdate) = 5), 2) AS fri,
   round(sum(l_extendedprice) FILTER (isodow(l_shipdate) = 7), 2) AS sun FROM lineitem GROUP BY 1)
SELECT a.wk, a.mon / b.mon AS mon, a.fri / b.fri AS fri, a.sun / b.sun AS sun FROM w a JOIN w b ON b.wk = a.wk + 52
WHERE a.wk BETWEEN 104 AND 155""",
)
def ds_week_ratio(t):
    week = F.floor(F.date_diff(F.date_trunc("week", "l_shipdate"), day("1995-01-02")) / 7).cast("int")
    shipped = t.lineitem.where((c("l_shipdate") >= day("1996-12-30")) & (c("l_shipdate") < day("1998-12-28")))
    days = {"mon": 0, "fri": 4, "sun": 6}

    def on(n):
        return total(F.when(F.weekday("l_shipdate") == n, c("l_extendedprice")))

    weekly = shipped.groupBy(week.alias("wk")).agg(*[on(n).alias(d) for d, n in days.items()])
    later = weekly.select((c("wk") - 52).alias("wk"), *[c(d).alias(f"{d}_later") for d in days])
    first_year = weekly.where(c("wk").between(104, 155))
    return first_year.join(later, "wk").select("wk", *[F.try_divide(d, f"{d}_later").alias(d) for d in days])


@query(
    "ds_share_window",
    """
WITH s AS (SELECT p_type, p_partkey, p_name, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN part
  ON p_partkey = l_partkey WHERE l_shipdate >= DATE '1999-02-22' AND l_shipdate <= DATE '1999-03-24'
  AND p_type IN ('PROMO', 'SMALL', 'LARGE') GROUP BY ALL)
SELECT p_type, p_partkey, p_name, v, v * 100 / round(sum(v) OVER (PARTITION BY p_type), 2) AS pct FROM s""",
)
def ds_share_window(t):
    lines = t.lineitem.where((c("l_shipdate") >= day("1999-02-22")) & (c("l_shipdate") <= day("1999-03-24")))
    items = t.part.where(c("p_type").isin("PROMO", "SMALL", "LARGE")).select("p_partkey", "p_type", "p_name")
    sold = (
        lines.groupBy(c("l_partkey").alias("p_partkey"))
        .agg(total("l_extendedprice").alias("v"))
        .join(items, "p_partkey")
    )
    classes = sold.groupBy("p_type").agg(total("v").alias("class_v"))
    return sold.join(classes, "p_type").select(
        "p_type", "p_partkey", "p_name", "v", F.try_divide(c("v") * 100, "class_v").alias("pct")
    )


@query(
    "ds_dev_window",
    """
WITH m AS (SELECT p_brand, CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(month(l_shipdate) AS INTEGER) AS mo,
   round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
 a AS (SELECT *, round(sum(v) OVER y, 2) / count(*) OVER y AS mean, lag(v) OVER o AS before, lead(v) OVER o AS after,
   lag(yr * 12 + mo) OVER o AS b, lead(yr * 12 + mo) OVER o AS f FROM m
   WINDOW y AS (PARTITION BY p_brand, yr), o AS (PARTITION BY p_brand ORDER BY yr, mo))
SELECT p_brand, yr, mo, v, mean, before, after FROM a WHERE yr = 1998 AND abs(v - mean) / mean > 0.1
 AND b = yr * 12 + mo - 1 AND f = yr * 12 + mo + 1""",
)
def ds_dev_window(t):
    monthly = (
        t.lineitem.groupBy("l_partkey", year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mo"))
        .agg(F.sum("l_extendedprice").alias("v"))
        .join(t.part.select("p_partkey", "p_brand"), line_part())
        .groupBy("p_brand", "yr", "mo")
        .agg(total("v").alias("v"))
    )
    in_year = Window.partitionBy("p_brand", "yr")
    in_order = Window.partitionBy("p_brand").orderBy("yr", "mo")
    place = c("yr") * 12 + c("mo")
    seen = monthly.select(
        "*",
        (F.round(F.sum("v").over(in_year), 2) / F.count("*").over(in_year)).alias("mean"),
        F.lag("v").over(in_order).alias("before"),
        F.lead("v").over(in_order).alias("after"),
        F.lag(place).over(in_order).alias("b"),
        F.lead(place).over(in_order).alias("f"),
    )
    adjacent = (c("b") == place - 1) & (c("f") == place + 1)
    return seen.where(
        (c("yr") == 1998) & (F.abs(c("v") - c("mean")) / c("mean") > 0.1) & adjacent
    ).select("p_brand", "yr", "mo", "v", "mean", "before", "after")


@query(
    "ds_running_cross",
    """
WITH d AS (SELECT p_brand, l_returnflag AS f, CAST(l_shipdate AS DATE) AS dt, sum(l_quantity) AS q FROM lineitem
  JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('A', 'R') AND year(l_shipdate) = 1998 GROUP BY ALL),
 s AS (SELECT *, sum(q) OVER (PARTITION BY p_brand, f ORDER BY dt) AS so_far FROM d),
 j AS (SELECT coalesce(a.p_brand, r.p_brand) AS p_brand, coalesce(a.dt, r.dt) AS dt, a.so_far AS a_now, r.so_far AS r_now
  FROM (SELECT * FROM s WHERE f = 'A') a FULL JOIN (SELECT * FROM s WHERE f = 'R') r ON r.p_brand = a.p_brand AND r.dt = a.dt),
 k AS (SELECT *, max(a_now) OVER w AS a_top, max(r_now) OVER w AS r_top FROM j
  WINDOW w AS (PARTITION BY p_brand ORDER BY dt))
SELECT p_brand, dt, a_top, r_top FROM k WHERE a_top > r_top""",
)
def ds_running_cross(t):
    daily = (
        t.lineitem.where(
            c("l_returnflag").isin("A", "R")
            & (c("l_shipdate") >= day("1998-01-01"))
            & (c("l_shipdate") < day("1999-01-01"))
        )
        .join(t.part.select("p_partkey", "p_brand"), line_part())
        .groupBy("p_brand", "l_returnflag", c("l_shipdate").cast("date").alias("dt"))
        .agg(F.sum("l_quantity").alias("q"))
    )
    w = Window.partitionBy("p_brand", "l_returnflag").orderBy("dt")
    running = daily.withColumn("so_far", F.sum("q").over(w))

    def side(flag, name):
        return running.where(c("l_returnflag") == flag).select("p_brand", "dt", c("so_far").alias(name))

    both = side("A", "a_now").join(side("R", "r_now"), ["p_brand", "dt"], "full")
    by_day = Window.partitionBy("p_brand").orderBy("dt")
    tops = both.select(
        "p_brand", "dt", F.max("a_now").over(by_day).alias("a_top"), F.max("r_now").over(by_day).alias("r_top")
    )
    return tops.where(c("a_top") > c("r_top"))


@query(
    "ds_multi_exists",
    """
WITH l AS (SELECT o_custkey, l_returnflag AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-05-01')
SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer
WHERE EXISTS (SELECT 1 FROM l WHERE o_custkey = c_custkey AND f = 'R')
 AND (EXISTS (SELECT 1 FROM l WHERE o_custkey = c_custkey AND f = 'A')
  OR EXISTS (SELECT 1 FROM l WHERE o_custkey = c_custkey AND f = 'N'))
GROUP BY ALL""",
)
def ds_multi_exists(t):
    # the three tests share one pass: flags seen per customer
    seen = (
        t.lineitem.where((c("l_shipdate") >= day("1997-01-01")) & (c("l_shipdate") < day("1997-05-01")))
        .join(t.orders, line_order())
        .groupBy("o_custkey")
        .agg(
            F.bool_or(c("l_returnflag") == "R").alias("returned"),
            F.bool_or(c("l_returnflag").isin("A", "N")).alias("kept"),
        )
        .where(c("returned") & c("kept"))
    )
    return (
        t.customer.join(seen, c("c_custkey") == c("o_custkey"), "left_semi")
        .groupBy("c_mktsegment", "c_nationkey")
        .agg(F.count("*").alias("n"), total("c_acctbal").alias("balance"))
    )


@query(
    "ds_multi_source_orders",
    """
SELECT count(DISTINCT l_orderkey) AS orders, round(sum(l_extendedprice), 2) AS price FROM lineitem l
WHERE l_shipdate >= DATE '1999-02-01' AND l_shipdate < DATE '1999-04-02'
 AND EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_suppkey <> l.l_suppkey)
 AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = l.l_orderkey AND r.l_returnflag = 'R')""",
)
def ds_multi_source_orders(t):
    in_window = (c("l_shipdate") >= day("1999-02-01")) & (c("l_shipdate") < day("1999-04-02"))
    per_order = (
        t.lineitem.groupBy("l_orderkey")
        .agg(
            F.min("l_suppkey").alias("lo"),
            F.max("l_suppkey").alias("hi"),
            F.bool_or(c("l_returnflag") == "R").alias("returned"),
            F.count_if(in_window).alias("k"),
            F.sum(F.when(in_window, c("l_extendedprice"))).alias("price"),
        )
        .where((c("lo") < c("hi")) & ~c("returned") & (c("k") > 0))
    )
    return per_order.agg(F.count("*").alias("orders"), total("price").alias("price"))


@query(
    "ds_set_count",
    """
WITH p AS (SELECT DISTINCT o_custkey, l_partkey, l_returnflag AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 a AS (SELECT o_custkey, l_partkey FROM p WHERE f = 'A'), n AS (SELECT o_custkey, l_partkey FROM p WHERE f = 'N'),
 r AS (SELECT o_custkey, l_partkey FROM p WHERE f = 'R')
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM r)) AS a_and_r,
 (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM r)) AS a_not_r,
 (SELECT count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM a)) AS r_not_a,
 (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM n EXCEPT SELECT * FROM r)) AS a_alone""",
)
def ds_set_count(t):
    def flag(f):
        return F.bool_or(c("l_returnflag") == f)

    pairs = (
        t.lineitem.join(t.orders, line_order())
        .groupBy("o_custkey", "l_partkey")
        .agg(flag("A").alias("a"), flag("N").alias("n"), flag("R").alias("r"))
    )
    return pairs.agg(
        F.count_if(c("a") & c("r")).alias("a_and_r"),
        F.count_if(c("a") & ~c("r")).alias("a_not_r"),
        F.count_if(c("r") & ~c("a")).alias("r_not_a"),
        F.count_if(c("a") & ~c("n") & ~c("r")).alias("a_alone"),
    )


@query(
    "ds_event_chain",
    """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS dt, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS k,
   count(*) FILTER (event_type = 'purchase') AS p, round(sum(value) FILTER (event_type = 'purchase'), 2) AS value
  FROM events GROUP BY ALL)
SELECT a.user_id, count(*) AS chains, CAST(sum(z.p) AS BIGINT) AS purchases, round(sum(z.value), 2) AS value
FROM d a JOIN d b ON b.user_id = a.user_id AND b.k AND b.dt BETWEEN a.dt AND a.dt + 2
JOIN d z ON z.user_id = a.user_id AND z.p > 0 AND z.dt BETWEEN b.dt AND b.dt + 2 WHERE a.v GROUP BY a.user_id""",
)
def ds_event_chain(t):
    kind = c("event_type")
    days = t.events.groupBy("user_id", c("ts").cast("date").alias("dt")).agg(
        F.bool_or(kind == "view").alias("v"),
        F.bool_or(kind == "click").alias("k"),
        F.count_if(kind == "purchase").alias("p"),
        total(F.when(kind == "purchase", c("value"))).alias("value"),
    )
    # one row per user and day; a step within two days is three equality keys, not a range join
    ahead = F.explode(F.sequence("dt", F.date_add("dt", 2)))
    views = days.where("v").select("user_id", ahead.alias("dt"))
    clicks = views.join(days.where("k").select("user_id", "dt"), ["user_id", "dt"])
    reach = clicks.groupBy("user_id", "dt").agg(F.count("*").alias("ways")).select(
        "user_id", "ways", ahead.alias("dt")
    )
    chains = reach.join(days.where(c("p") > 0).select("user_id", "dt", "p", "value"), ["user_id", "dt"])
    return chains.groupBy("user_id").agg(
        F.sum("ways").alias("chains"),
        F.sum(c("p") * c("ways")).alias("purchases"),
        total(c("value") * c("ways")).alias("value"),
    )


@query(
    "ds_net_of_returns",
    """
WITH s AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS sold,
   sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS back,
   round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS net
  FROM lineitem GROUP BY l_partkey)
SELECT p_type, p_partkey, net, back / sold AS return_ratio FROM s JOIN part ON p_partkey = l_partkey WHERE sold > 0
QUALIFY rank() OVER (PARTITION BY p_type ORDER BY back / sold DESC) <= 10""",
)
def ds_net_of_returns(t):
    back = c("l_returnflag") == "R"
    per_part = t.lineitem.groupBy(c("l_partkey").alias("p_partkey")).agg(
        F.sum(F.when(back, 0.0).otherwise(c("l_quantity"))).alias("sold"),
        F.sum(F.when(back, c("l_quantity")).otherwise(0.0)).alias("back"),
        total(F.when(back, -c("l_extendedprice")).otherwise(c("l_extendedprice"))).alias("net"),
    )
    rated = per_part.where(c("sold") > 0).join(t.part.select("p_partkey", "p_type"), "p_partkey").select(
        "p_type", "p_partkey", "net", F.try_divide("back", "sold").alias("return_ratio")
    )
    worst = Window.partitionBy("p_type").orderBy(F.desc("return_ratio"))
    return rated.withColumn("r", F.rank().over(worst)).where(c("r") <= 10).drop("r")


@query(
    "ds_bucket_pivot",
    """
SELECT l_returnflag, count(*) FILTER (d <= 30) AS d30, count(*) FILTER (d > 30 AND d <= 60) AS d60,
  count(*) FILTER (d > 60 AND d <= 90) AS d90, count(*) FILTER (d > 90 AND d <= 120) AS d120,
  count(*) FILTER (d > 120) AS later,
  CASE WHEN count(*) FILTER (l_quantity <= 20) > 4000 THEN round(sum(l_discount) FILTER (l_quantity <= 20), 2)
    / count(*) FILTER (l_quantity <= 20) ELSE round(sum(l_tax) FILTER (l_quantity <= 20), 2)
    / count(*) FILTER (l_quantity <= 20) END AS small_pick
FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem
 JOIN orders ON o_orderkey = l_orderkey) GROUP BY l_returnflag""",
)
def ds_bucket_pivot(t):
    lag = c("lag")
    small = c("l_quantity") <= 20
    lines = t.lineitem.join(t.orders, line_order()).withColumn("lag", F.date_diff("l_shipdate", "o_orderdate"))
    return lines.groupBy("l_returnflag").agg(
        F.count_if(lag <= 30).alias("d30"),
        F.count_if((lag > 30) & (lag <= 60)).alias("d60"),
        F.count_if((lag > 60) & (lag <= 90)).alias("d90"),
        F.count_if((lag > 90) & (lag <= 120)).alias("d120"),
        F.count_if(lag > 120).alias("later"),
        F.when(F.count_if(small) > 4000, mean(F.when(small, c("l_discount"))))
        .otherwise(mean(F.when(small, c("l_tax"))))
        .alias("small_pick"),
    )


@query(
    "ds_before_after",
    """
WITH s AS (SELECT p_brand, sum(l_quantity) FILTER (l_shipdate < DATE '1998-03-11') AS before,
   sum(l_quantity) FILTER (l_shipdate >= DATE '1998-03-11') AS after FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_shipdate >= DATE '1998-02-09' AND l_shipdate <= DATE '1998-04-10' GROUP BY p_brand)
SELECT p_brand, before, after FROM s WHERE before > 0 AND after / before BETWEEN 2.0 / 3.0 AND 1.5""",
)
def ds_before_after(t):
    cut = day("1998-03-11")
    lines = t.lineitem.where((c("l_shipdate") >= day("1998-02-09")) & (c("l_shipdate") <= day("1998-04-10")))
    sums = (
        lines.join(t.part, line_part())
        .groupBy("p_brand")
        .agg(
            F.sum(F.when(c("l_shipdate") < cut, c("l_quantity"))).alias("before"),
            F.sum(F.when(c("l_shipdate") >= cut, c("l_quantity"))).alias("after"),
        )
    )
    return sums.where((c("before") > 0) & (c("after") / c("before")).between(2.0 / 3.0, 1.5))


@query(
    "ds_basket_size",
    """
WITH b AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) BETWEEN 5 AND 7)
SELECT c_custkey, c_name, count(*) AS baskets, CAST(sum(n) AS BIGINT) AS lines FROM b JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey WHERE day(o_orderdate) BETWEEN 1 AND 3 GROUP BY ALL""",
)
def ds_basket_size(t):
    baskets = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).where(c("n").between(5, 7))
    early = t.orders.where(F.dayofmonth("o_orderdate").between(1, 3))
    return (
        baskets.join(early, line_order())
        .groupBy("o_custkey")
        .agg(F.count("*").alias("baskets"), F.sum("n").alias("lines"))
        .join(t.customer, c("o_custkey") == c("c_custkey"))
        .select("c_custkey", "c_name", "baskets", "lines")
    )


@query(
    "ds_band_exists",
    """
SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice BETWEEN 920 AND 950 AND p_brand IN ('Brand#2',
 'Brand#12', 'Brand#17', 'Brand#23') AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey
 AND l_quantity BETWEEN 40 AND 50 AND l_shipdate >= DATE '1998-05-25' AND l_shipdate <= DATE '1998-07-24')""",
)
def ds_band_exists(t):
    band = t.part.where(
        c("p_retailprice").between(920, 950) & c("p_brand").isin("Brand#2", "Brand#12", "Brand#17", "Brand#23")
    )
    shipped = t.lineitem.where(
        c("l_quantity").between(40, 50)
        & (c("l_shipdate") >= day("1998-05-25"))
        & (c("l_shipdate") <= day("1998-07-24"))
    )
    return band.join(shipped, line_part(), "left_semi").select("p_partkey", "p_name", "p_retailprice")


@query(
    "ds_volatility",
    """
WITH m AS (SELECT l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS mo, avg(l_quantity) AS mean,
   stddev_samp(l_quantity) / avg(l_quantity) AS cv, count(*) AS n FROM lineitem
  WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY ALL),
 v AS (SELECT * FROM m WHERE cv > 0.6)
SELECT a.l_suppkey, a.mo, round(a.mean, 9) AS mean1, round(a.cv, 9) AS cv1, round(b.mean, 9) AS mean2,
 round(b.cv, 9) AS cv2 FROM v a JOIN v b ON b.l_suppkey = a.l_suppkey AND b.mo = a.mo + 1""",
)
def ds_volatility(t):
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    shipped = t.lineitem.where((c("l_shipdate") >= day("1998-01-01")) & (c("l_shipdate") < day("1999-01-01")))
    monthly = shipped.groupBy("l_suppkey", month.alias("mo")).agg(
        F.avg("l_quantity").alias("mean"),
        F.try_divide(F.stddev_samp("l_quantity"), F.avg("l_quantity")).alias("cv"),
    )
    unsteady = monthly.where(c("cv") > 0.6)
    later = unsteady.select("l_suppkey", (c("mo") - 1).alias("mo"), c("mean").alias("mean2"), c("cv").alias("cv2"))
    return unsteady.join(later, ["l_suppkey", "mo"]).select(
        "l_suppkey", "mo", *[F.round(x, 9).alias(n) for x, n in (("mean", "mean1"), ("cv", "cv1"), ("mean2", "mean2"), ("cv2", "cv2"))]
    )


@query(
    "ds_frequent_best",
    """
WITH fp AS (SELECT DISTINCT l_partkey AS k FROM (SELECT l_partkey, year(l_shipdate) AS y, count(*) AS n FROM lineitem
   GROUP BY ALL) WHERE n > 8),
 sp AS (SELECT o_custkey, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  GROUP BY o_custkey), bc AS (SELECT o_custkey FROM sp WHERE v > 0.5 * (SELECT max(v) FROM sp))
SELECT c_name, l_returnflag AS channel, round(sum(l_quantity * l_extendedprice), 2) AS sales
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
WHERE l_shipdate >= DATE '1998-02-01' AND l_shipdate < DATE '1998-08-01' AND l_partkey IN (SELECT k FROM fp)
 AND orders.o_custkey IN (SELECT o_custkey FROM bc) GROUP BY ALL""",
)
def ds_frequent_best(t):
    frequent = (
        t.lineitem.groupBy("l_partkey", F.year("l_shipdate").alias("y"))
        .agg(F.count("*").alias("n"))
        .where(c("n") > 8)
        .select("l_partkey")
        .distinct()
    )
    spend = t.lineitem.join(t.orders, line_order()).groupBy("o_custkey").agg(total("l_extendedprice").alias("v"))
    best = spend.where(c("v") > 0.5 * spend.agg(F.max("v")).scalar()).select("o_custkey")
    lines = t.lineitem.where((c("l_shipdate") >= day("1998-02-01")) & (c("l_shipdate") < day("1998-08-01")))
    return (
        lines.join(frequent, "l_partkey", "left_semi")
        .join(t.orders.join(best, "o_custkey", "left_semi"), line_order())
        .groupBy("o_custkey", c("l_returnflag").alias("channel"))
        .agg(total(c("l_quantity") * c("l_extendedprice")).alias("sales"))
        .join(t.customer, c("o_custkey") == c("c_custkey"))
        .select("c_name", "channel", "sales")
    )


@query(
    "ds_best_worst",
    """
WITH s AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS v FROM lineitem
  WHERE l_returnflag = 'N' GROUP BY l_suppkey),
 b AS (SELECT *, rank() OVER (ORDER BY v DESC) AS place FROM s), w AS (SELECT *, rank() OVER (ORDER BY v) AS place FROM s)
SELECT CAST(b.place AS INTEGER) AS place, b.l_suppkey AS best, b.v AS best_v, w.l_suppkey AS worst, w.v AS worst_v
FROM b JOIN w USING (place) WHERE place <= 10""",
)
def ds_best_worst(t):
    sums = t.lineitem.where(c("l_returnflag") == "N").groupBy("l_suppkey").agg(total(revenue(), 4).alias("v"))

    def side(order, key, value):
        place = F.rank().over(Window.orderBy(order))
        # rank <= 10 is a per-task limit before the single final task
        return sums.withColumn("place", place).where(c("place") <= 10).select(
            "place", c("l_suppkey").alias(key), c("v").alias(value)
        )

    return side(F.desc("v"), "best", "best_v").join(side(F.asc("v"), "worst", "worst_v"), "place")


@query(
    "ds_balanced_channels",
    """
WITH s AS (SELECT l_partkey, round(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 2) AS a,
  round(sum(l_extendedprice) FILTER (l_returnflag = 'N'), 2) AS n, round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS r
  FROM lineitem GROUP BY l_partkey), m AS (SELECT *, round(a + n + r, 2) / 3 AS mean FROM s)
SELECT l_partkey, a, n, r, mean FROM m WHERE a BETWEEN 0.9 * mean AND 1.1 * mean AND n BETWEEN 0.9 * mean AND 1.1 * mean
 AND r BETWEEN 0.9 * mean AND 1.1 * mean""",
)
def ds_balanced_channels(t):
    def channel(flag):
        return total(F.when(c("l_returnflag") == flag, c("l_extendedprice")))

    sums = t.lineitem.groupBy("l_partkey").agg(*[channel(f).alias(f.lower()) for f in "ANR"])
    near = [c(x).between(0.9 * c("mean"), 1.1 * c("mean")) for x in "anr"]
    return sums.withColumn("mean", F.round(c("a") + c("n") + c("r"), 2) / 3).where(near[0] & near[1] & near[2])


@query(
    "ds_spend_segments",
    """
WITH s AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= DATE '1998-12-01'
  AND o_orderdate < DATE '1999-03-01' GROUP BY o_custkey)
SELECT CAST(floor(v / 100000) AS BIGINT) AS segment, count(*) AS customers FROM s GROUP BY 1""",
)
def ds_spend_segments(t):
    spend = (
        t.orders.where((c("o_orderdate") >= day("1998-12-01")) & (c("o_orderdate") < day("1999-03-01")))
        .groupBy("o_custkey")
        .agg(F.sum("o_totalprice").alias("v"))
    )
    return spend.groupBy(F.floor(c("v") / 100000).alias("segment")).agg(F.count("*").alias("customers"))



