"""The 22 decision-support questions, each for its default parameters and for all its variants at once.

Re-aimed where the given tables lack a column: a late line ships more than 60 days after its order, a part's
cost is its retail price, the return flag stands for the ship mode.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.functions.numeric import day, mean, revenue, share, total, year
from assayer.functions.variants import in_any, setting, tagged, unfold
from assayer.registry import query

c = F.col

LATE_SQL = "l_shipdate > o_orderdate + INTERVAL 60 DAY"


def late():
    return c("l_shipdate") > c("o_orderdate") + F.expr("INTERVAL 60 DAY")


def family(name: str, settings: list[dict], sql: str):
    """Register ``name`` for the first setting and ``name_variants`` for all; ``sql`` has ``{param}`` places."""

    def add(plan):
        query(name, sql.format(**settings[0]))(lambda t: plan(t, settings[:1]).drop("variant"))
        every = " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS variant, * FROM ({sql.format(**s)})" for i, s in enumerate(settings)
        )
        query(f"{name}_variants", every)(lambda t: plan(t, settings))
        return plan

    return add


def top_per_variant(df, k, *order):
    """The first ``k`` rows of every variant; each map task keeps only ``k`` per variant before the shuffle."""
    w = Window.partitionBy("variant").orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(c("_place") <= k).drop("_place")


def line_order():
    return c("l_orderkey") == c("o_orderkey")


# ---------------------------------------------------------------- 1


@family(
    "tpch_q01",
    [{"d": "1998-09-02"}, {"d": "1998-08-15"}, {"d": "1998-10-01"}],
    """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(sum(l_quantity), 2) / count(*) AS avg_qty, round(sum(l_extendedprice), 2) / count(*) AS avg_price,
  round(sum(l_discount), 2) / count(*) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '{d}' GROUP BY ALL""",
)
def pricing_summary(t, settings):
    parts = (
        tagged(t.lineitem, [c("l_shipdate") <= day(s["d"]) for s in settings])
        .groupBy("l_returnflag", "l_linestatus", "variants")
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.sum("l_extendedprice").alias("base"),
            F.sum(revenue()).alias("disc"),
            F.sum(revenue() * (1 + c("l_tax"))).alias("charge"),
            F.sum("l_discount").alias("discount"),
            F.count("*").alias("k"),
        )
    )
    return (
        unfold(parts)
        .groupBy("variant", "l_returnflag", "l_linestatus")
        .agg(
            total("qty").alias("sum_qty"),
            total("base").alias("sum_base"),
            total("disc", 4).alias("sum_disc"),
            total("charge").alias("sum_charge"),
            (total("qty") / F.sum("k")).alias("avg_qty"),
            (total("base") / F.sum("k")).alias("avg_price"),
            (total("discount") / F.sum("k")).alias("avg_disc"),
            F.sum("k").alias("n"),
        )
    )


# ---------------------------------------------------------------- 2


@query(
    "tpch_q02",
    """
WITH offers AS (SELECT DISTINCT l_partkey, l_suppkey, l_extendedprice AS price, s_acctbal, s_name, n_name
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE p_size = 15 AND r_name = 'EUROPE')
SELECT s_acctbal, s_name, n_name, l_partkey AS p_partkey, price FROM offers o
WHERE price = (SELECT min(price) FROM offers i WHERE i.l_partkey = o.l_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
)
def cheapest_supplier(t):
    europe = (
        t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey"))
        .join(t.region.where(c("r_name") == "EUROPE"), c("n_regionkey") == c("r_regionkey"))
        .select("s_suppkey", "s_acctbal", "s_name", "n_name")
    )
    offers = (
        t.lineitem.join(t.part.where(c("p_size") == 15), c("l_partkey") == c("p_partkey"))
        .join(europe, c("l_suppkey") == c("s_suppkey"))
        .groupBy("p_partkey", "s_suppkey", "s_acctbal", "s_name", "n_name")
        .agg(F.min("l_extendedprice").alias("price"))
    )
    lowest = offers.groupBy("p_partkey").agg(F.min("price").alias("price"))
    return (
        offers.join(lowest, ["p_partkey", "price"])
        .select("s_acctbal", "s_name", "n_name", "p_partkey", "price")
        .orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey")
        .limit(100)
    )


# ---------------------------------------------------------------- 3


@family(
    "tpch_q03",
    [
        {"seg": "BUILDING", "d": "1998-03-15"},
        {"seg": "AUTOMOBILE", "d": "1998-03-01"},
        {"seg": "MACHINERY", "d": "1998-03-28"},
    ],
    """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, CAST(o_orderdate AS DATE) AS placed
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = '{seg}' AND o_orderdate < DATE '{d}' AND l_shipdate > DATE '{d}'
GROUP BY ALL ORDER BY revenue DESC, placed, l_orderkey LIMIT 10""",
)
def shipping_priority(t, settings):
    wanted = [
        (c("c_mktsegment") == s["seg"]) & (c("o_orderdate") < day(s["d"])) & (c("l_shipdate") > day(s["d"]))
        for s in settings
    ]
    days = [s["d"] for s in settings]
    customers = t.customer.where(c("c_mktsegment").isin([s["seg"] for s in settings]))
    orders = t.orders.where(c("o_orderdate") < day(max(days)))
    lines = t.lineitem.where(c("l_shipdate") > day(min(days)))
    joined = lines.join(orders.join(customers, c("o_custkey") == c("c_custkey")), line_order())
    placed = c("o_orderdate").cast("date").alias("placed")
    sums = tagged(joined, wanted).groupBy("l_orderkey", placed, "variants").agg(F.sum(revenue()).alias("v"))
    per_order = unfold(sums).groupBy("variant", "l_orderkey", "placed").agg(total("v", 4).alias("revenue"))
    return top_per_variant(per_order, 10, F.desc("revenue"), "placed", "l_orderkey")


# ---------------------------------------------------------------- 4


@family(
    "tpch_q04",
    [
        {"d": "1996-07-01", "d2": "1996-10-01"},
        {"d": "1996-10-01", "d2": "1997-01-01"},
        {"d": "1997-01-01", "d2": "1997-04-01"},
    ],
    f"""
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '{{d}}' AND o_orderdate < DATE '{{d2}}'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {LATE_SQL}) GROUP BY o_orderpriority""",
)
def late_orders(t, settings):
    placed = tagged(
        t.orders, [(c("o_orderdate") >= day(s["d"])) & (c("o_orderdate") < day(s["d2"])) for s in settings]
    )
    kept = placed.join(t.lineitem, line_order() & late(), "left_semi")
    counts = kept.groupBy("o_orderpriority", "variants").agg(F.count("*").alias("k"))
    return unfold(counts).groupBy("variant", "o_orderpriority").agg(F.sum("k").alias("n"))


# ---------------------------------------------------------------- 5


@family(
    "tpch_q05",
    [
        {"r": "ASIA", "d": "1996-01-01", "d2": "1997-01-01"},
        {"r": "EUROPE", "d": "1997-01-01", "d2": "1998-01-01"},
        {"r": "AMERICA", "d": "1998-01-01", "d2": "1999-01-01"},
    ],
    """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey
WHERE r_name = '{r}' AND o_orderdate >= DATE '{d}' AND o_orderdate < DATE '{d2}' GROUP BY n_name""",
)
def local_supplier_volume(t, settings):
    placed = [(c("o_orderdate") >= day(s["d"])) & (c("o_orderdate") < day(s["d2"])) for s in settings]
    wanted = [(c("r_name") == s["r"]) & p for s, p in zip(settings, placed)]
    places = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).where(
        c("r_name").isin([s["r"] for s in settings])
    )
    customers = t.customer.join(places, c("c_nationkey") == c("n_nationkey"))
    joined = (
        t.lineitem.join(t.orders.where(in_any(placed)).join(customers, c("o_custkey") == c("c_custkey")), line_order())
        .join(t.supplier, (c("l_suppkey") == c("s_suppkey")) & (c("s_nationkey") == c("c_nationkey")))
    )
    sums = tagged(joined, wanted).groupBy("n_name", "variants").agg(F.sum(revenue()).alias("v"))
    return unfold(sums).groupBy("variant", "n_name").agg(total("v", 4).alias("revenue"))


# ---------------------------------------------------------------- 6


@family(
    "tpch_q06",
    [
        {"d": "1996-01-01", "d2": "1997-01-01", "lo": 0.05, "hi": 0.07, "qty": 24},
        {"d": "1997-01-01", "d2": "1998-01-01", "lo": 0.07, "hi": 0.09, "qty": 25},
        {"d": "1998-01-01", "d2": "1999-01-01", "lo": 0.03, "hi": 0.05, "qty": 23},
    ],
    """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '{d}' AND l_shipdate < DATE '{d2}' AND l_discount BETWEEN {lo} AND {hi}
  AND l_quantity < {qty}""",
)
def forecast_revenue(t, settings):
    wanted = [
        (c("l_shipdate") >= day(s["d"]))
        & (c("l_shipdate") < day(s["d2"]))
        & c("l_discount").between(s["lo"], s["hi"])
        & (c("l_quantity") < s["qty"])
        for s in settings
    ]
    sums = tagged(t.lineitem, wanted).groupBy("variants").agg(F.sum(c("l_extendedprice") * c("l_discount")).alias("v"))
    return unfold(sums).groupBy("variant").agg(total("v", 4).alias("revenue"))


# ---------------------------------------------------------------- 7


@family(
    "tpch_q07",
    [
        {"a": "NATION_6", "b": "NATION_7"},
        {"a": "NATION_12", "b": "NATION_8"},
        {"a": "NATION_2", "b": "NATION_1"},
    ],
    """
SELECT s.n_name AS supp_nation, k.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS yr,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation s ON s.n_nationkey = s_nationkey
JOIN nation k ON k.n_nationkey = c_nationkey
WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1999-01-01'
  AND ((s.n_name = '{a}' AND k.n_name = '{b}') OR (s.n_name = '{b}' AND k.n_name = '{a}')) GROUP BY ALL""",
)
def volume_shipping(t, settings):
    names = sorted({s[x] for s in settings for x in "ab"})
    some = t.nation.where(c("n_name").isin(names)).select("n_nationkey", "n_name")
    suppliers = t.supplier.join(some.withColumnRenamed("n_name", "supp_nation"), c("s_nationkey") == c("n_nationkey"))
    customers = t.customer.join(some.withColumnRenamed("n_name", "cust_nation"), c("c_nationkey") == c("n_nationkey"))
    shipped = t.lineitem.where((c("l_shipdate") >= day("1997-01-01")) & (c("l_shipdate") < day("1999-01-01")))
    joined = (
        shipped.join(suppliers.drop("n_nationkey"), c("l_suppkey") == c("s_suppkey"))
        .join(t.orders, line_order())
        .join(customers.drop("n_nationkey"), c("o_custkey") == c("c_custkey"))
    )

    def pair(a, b):
        return (c("supp_nation") == a) & (c("cust_nation") == b)

    wanted = [pair(s["a"], s["b"]) | pair(s["b"], s["a"]) for s in settings]
    sums = (
        tagged(joined, wanted)
        .groupBy("supp_nation", "cust_nation", year("l_shipdate").alias("yr"), "variants")
        .agg(F.sum(revenue()).alias("v"))
    )
    return unfold(sums).groupBy("variant", "supp_nation", "cust_nation", "yr").agg(total("v", 4).alias("revenue"))


# ---------------------------------------------------------------- 8, 9


@query(
    "tpch_q08",
    """
SELECT CAST(year(o_orderdate) AS INTEGER) AS yr,
  round(coalesce(sum(l_extendedprice * (1 - l_discount)) FILTER (s.n_name = 'NATION_6'), 0), 4)
   / round(sum(l_extendedprice * (1 - l_discount)), 4) AS mkt_share
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation k ON k.n_nationkey = c_nationkey
JOIN region ON r_regionkey = k.n_regionkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation s ON s.n_nationkey = s_nationkey
WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-01-01'
GROUP BY 1""",
)
def market_share(t):
    america = t.nation.join(t.region.where(c("r_name") == "AMERICA"), c("n_regionkey") == c("r_regionkey")).select(
        "n_nationkey"
    )
    buyers = t.customer.join(america, c("c_nationkey") == c("n_nationkey"), "left_semi")
    placed = t.orders.where((c("o_orderdate") >= day("1996-01-01")) & (c("o_orderdate") < day("1999-01-01")))
    suppliers = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name")
    yearly = (
        t.lineitem.join(t.part.where(c("p_type") == "ECONOMY"), c("l_partkey") == c("p_partkey"))
        .join(placed.join(buyers, c("o_custkey") == c("c_custkey"), "left_semi"), line_order())
        .join(suppliers, c("l_suppkey") == c("s_suppkey"))
        .groupBy(year("o_orderdate").alias("yr"))
        .agg(
            total(F.when(c("n_name") == "NATION_6", revenue()).otherwise(0.0), 4).alias("own"),
            total(revenue(), 4).alias("whole"),
        )
    )
    return yearly.select("yr", F.try_divide("own", "whole").alias("mkt_share"))


@query(
    "tpch_q09",
    """
SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS yr,
  round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity), 4) AS profit
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey WHERE p_name LIKE '%red%' GROUP BY ALL""",
)
def product_profit(t):
    red = t.part.where(c("p_name").contains("red"))
    return (
        t.lineitem.join(red, c("l_partkey") == c("p_partkey"))
        .join(t.supplier, c("l_suppkey") == c("s_suppkey"))
        .join(t.orders, line_order())
        .groupBy("s_nationkey", year("o_orderdate").alias("yr"))
        .agg(total(revenue() - c("p_retailprice") * c("l_quantity"), 4).alias("profit"))
        .join(t.nation, c("s_nationkey") == c("n_nationkey"))
        .select("n_name", "yr", "profit")
    )


# ---------------------------------------------------------------- 10


@family(
    "tpch_q10",
    [
        {"d": "1996-10-01", "d2": "1997-01-01"},
        {"d": "1997-01-01", "d2": "1997-04-01"},
        {"d": "1996-07-01", "d2": "1996-10-01"},
    ],
    """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate >= DATE '{d}' AND o_orderdate < DATE '{d2}'
 AND l_returnflag = 'R' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
def returned_items(t, settings):
    placed = tagged(
        t.orders, [(c("o_orderdate") >= day(s["d"])) & (c("o_orderdate") < day(s["d2"])) for s in settings]
    )
    lost = (
        t.lineitem.where(c("l_returnflag") == "R")
        .join(placed, line_order())
        .groupBy("o_custkey", "variants")
        .agg(F.sum(revenue()).alias("v"))
    )
    per_customer = unfold(lost).groupBy("variant", "o_custkey").agg(total("v", 4).alias("revenue"))
    best = top_per_variant(per_customer, 20, F.desc("revenue"), "o_custkey")
    return (
        best.join(t.customer, c("o_custkey") == c("c_custkey"))
        .join(t.nation, c("c_nationkey") == c("n_nationkey"))
        .select("variant", "c_custkey", "c_name", "revenue", "c_acctbal", "n_name")
    )


# ---------------------------------------------------------------- 11


@query(
    "tpch_q11",
    """
WITH g AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_7' GROUP BY l_partkey)
SELECT l_partkey AS p_partkey, q FROM g WHERE q > 0.0015 * (SELECT sum(q) FROM g)""",
)
def important_stock(t):
    home = t.nation.where(c("n_name") == "NATION_7")
    suppliers = t.supplier.join(home, c("s_nationkey") == c("n_nationkey"), "left_semi")
    stock = (
        t.lineitem.join(suppliers, c("l_suppkey") == c("s_suppkey"), "left_semi")
        .groupBy(c("l_partkey").alias("p_partkey"))
        .agg(F.sum("l_quantity").alias("q"))
    )
    return stock.where(c("q") > 0.0015 * stock.agg(F.sum("q")).scalar())


# ---------------------------------------------------------------- 12


@family(
    "tpch_q12",
    [
        {"m1": "A", "m2": "R", "d": "1996-01-01", "d2": "1997-01-01"},
        {"m1": "N", "m2": "A", "d": "1997-01-01", "d2": "1998-01-01"},
        {"m1": "R", "m2": "N", "d": "1998-01-01", "d2": "1999-01-01"},
    ],
    f"""
SELECT l_returnflag, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high,
  count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('{{m1}}', '{{m2}}')
 AND l_shipdate >= DATE '{{d}}' AND l_shipdate < DATE '{{d2}}' AND {LATE_SQL} GROUP BY l_returnflag""",
)
def priority_split(t, settings):
    wanted = [
        c("l_returnflag").isin(s["m1"], s["m2"]) & (c("l_shipdate") >= day(s["d"])) & (c("l_shipdate") < day(s["d2"]))
        for s in settings
    ]
    urgent = c("o_orderpriority").isin("1-URGENT", "2-HIGH")
    counts = (
        tagged(t.lineitem, wanted)
        .join(t.orders, line_order() & late())
        .groupBy("l_returnflag", "variants")
        .agg(F.count_if(urgent).alias("h"), F.count_if(~urgent).alias("l"))
    )
    return unfold(counts).groupBy("variant", "l_returnflag").agg(F.sum("h").alias("high"), F.sum("l").alias("low"))


# ---------------------------------------------------------------- 13


@query(
    "tpch_q13",
    """
SELECT n_orders, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer
 LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) GROUP BY n_orders""",
)
def customer_distribution(t):
    counts = (
        t.orders.where(c("o_orderpriority") != "5-LOW")
        .groupBy(c("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n_orders"))
    )
    every = t.customer.select("c_custkey").join(counts, "c_custkey", "left").fillna(0, ["n_orders"])
    return every.groupBy("n_orders").agg(F.count("*").alias("customers"))


# ---------------------------------------------------------------- 14


@family(
    "tpch_q14",
    [
        {"d": "1997-09-01", "d2": "1997-10-01"},
        {"d": "1997-10-01", "d2": "1997-11-01"},
        {"d": "1998-03-01", "d2": "1998-04-01"},
    ],
    """
SELECT 100 * round(coalesce(sum(l_extendedprice * (1 - l_discount)) FILTER (p_type LIKE 'PROMO%'), 0), 4)
  / round(sum(l_extendedprice * (1 - l_discount)), 4) AS promo_pct
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= DATE '{d}' AND l_shipdate < DATE '{d2}'""",
)
def promotion_effect(t, settings):
    shipped = tagged(
        t.lineitem, [(c("l_shipdate") >= day(s["d"])) & (c("l_shipdate") < day(s["d2"])) for s in settings]
    )
    promo = F.when(c("p_type").startswith("PROMO"), revenue()).otherwise(0.0)
    sums = (
        shipped.join(t.part, c("l_partkey") == c("p_partkey"))
        .groupBy("variants")
        .agg(F.sum(promo).alias("p"), F.sum(revenue()).alias("v"))
    )
    return unfold(sums).groupBy("variant").agg(share(total("p", 4), total("v", 4)).alias("promo_pct"))


# ---------------------------------------------------------------- 15, 16


@query(
    "tpch_q15",
    """
WITH r AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem
 WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, revenue FROM supplier JOIN r ON l_suppkey = s_suppkey
WHERE revenue = (SELECT max(revenue) FROM r)""",
)
def top_supplier(t):
    shipped = t.lineitem.where((c("l_shipdate") >= day("1996-01-01")) & (c("l_shipdate") < day("1996-04-01")))
    earned = shipped.groupBy("l_suppkey").agg(total(revenue(), 4).alias("revenue"))
    best = earned.where(c("revenue") == earned.agg(F.max("revenue")).scalar())
    return t.supplier.join(best, c("s_suppkey") == c("l_suppkey")).select("s_suppkey", "s_name", "revenue")


@query(
    "tpch_q16",
    """
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand <> 'Brand#2' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""",
)
def part_suppliers(t):
    parts = t.part.where(
        (c("p_brand") != "Brand#2")
        & ~c("p_type").startswith("MEDIUM")
        & c("p_size").isin(49, 14, 23, 45, 19, 3, 36, 9)
    )
    in_debt = t.supplier.where(c("s_acctbal") < 0)
    pairs = (
        t.lineitem.join(parts, c("l_partkey") == c("p_partkey"))
        .select("p_brand", "p_type", "p_size", "l_suppkey")
        .distinct()
        .join(in_debt, c("l_suppkey") == c("s_suppkey"), "left_anti")
    )
    return pairs.groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("suppliers"))


# ---------------------------------------------------------------- 17


@family(
    "tpch_q17",
    [{"b": "Brand#23"}, {"b": "Brand#11"}, {"b": "Brand#12"}],
    """
SELECT round(sum(l_extendedprice), 2) / 7 AS avg_yearly FROM lineitem l JOIN part ON p_partkey = l_partkey
JOIN (SELECT l_partkey AS k, round(sum(l_quantity), 2) / count(*) AS q FROM lineitem GROUP BY 1) ON k = p_partkey
WHERE p_brand = '{b}' AND l_quantity < 0.2 * q""",
)
def small_quantity(t, settings):
    parts = tagged(t.part.select("p_partkey", "p_brand"), [c("p_brand") == s["b"] for s in settings])
    lines = t.lineitem.join(parts, c("l_partkey") == c("p_partkey")).select(
        "l_partkey", "l_quantity", "l_extendedprice", "variants"
    )
    typical = lines.groupBy("l_partkey").agg(mean("l_quantity").alias("q"))
    small = lines.join(typical, "l_partkey").where(c("l_quantity") < 0.2 * c("q"))
    sums = small.groupBy("variants").agg(F.sum("l_extendedprice").alias("v"))
    return unfold(sums).groupBy("variant").agg((total("v") / 7).alias("avg_yearly"))


# ---------------------------------------------------------------- 18


@family(
    "tpch_q18",
    [{"q": 300}, {"q": 312}, {"q": 295}],
    """
SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS placed, o_totalprice, q AS quantity
FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > {q})
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
ORDER BY o_totalprice DESC, placed, o_orderkey LIMIT 100""",
)
def large_orders(t, settings):
    sums = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    large = unfold(tagged(sums, [c("quantity") > s["q"] for s in settings]))
    orders = large.join(t.orders, line_order()).select(
        "variant", "o_custkey", "o_orderkey", c("o_orderdate").cast("date").alias("placed"), "o_totalprice", "quantity"
    )
    best = top_per_variant(orders, 100, F.desc("o_totalprice"), "placed", "o_orderkey")
    return best.join(t.customer, c("o_custkey") == c("c_custkey")).select(
        "variant", "c_name", "c_custkey", "o_orderkey", "placed", "o_totalprice", "quantity"
    )


# ---------------------------------------------------------------- 19


@query(
    "tpch_q19",
    """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
   OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
   OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""",
)
def discounted_revenue(t):
    def profile(brand, low, high, size):
        return (c("p_brand") == brand) & c("l_quantity").between(low, high) & c("p_size").between(1, size)

    wanted = profile("Brand#12", 1, 11, 5) | profile("Brand#23", 10, 20, 10) | profile("Brand#4", 20, 30, 15)
    return t.lineitem.join(t.part, (c("l_partkey") == c("p_partkey")) & wanted).agg(
        total(revenue(), 4).alias("revenue")
    )


# ---------------------------------------------------------------- 20


@family(
    "tpch_q20",
    [
        {"n": "NATION_3", "p": "red", "d": "1996-01-01", "d2": "1997-01-01"},
        {"n": "NATION_17", "p": "blue", "d": "1997-01-01", "d2": "1998-01-01"},
        {"n": "NATION_5", "p": "hot", "d": "1998-01-01", "d2": "1999-01-01"},
    ],
    """
WITH s AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE p_name LIKE '{p}%' AND l_shipdate >= DATE '{d}' AND l_shipdate < DATE '{d2}' GROUP BY ALL),
 w AS (SELECT l_partkey, sum(q) AS q FROM s GROUP BY l_partkey)
SELECT DISTINCT s_suppkey, s_name FROM s JOIN w USING (l_partkey) JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey WHERE n_name = '{n}' AND s.q > 0.5 * w.q""",
)
def excess_suppliers(t, settings):
    wanted = [
        c("p_name").startswith(s["p"]) & (c("l_shipdate") >= day(s["d"])) & (c("l_shipdate") < day(s["d2"]))
        for s in settings
    ]
    parts = t.part.where(in_any([c("p_name").startswith(s["p"]) for s in settings])).select("p_partkey", "p_name")
    joined = t.lineitem.join(parts, c("l_partkey") == c("p_partkey"))
    sums = tagged(joined, wanted).groupBy("l_partkey", "l_suppkey", "variants").agg(F.sum("l_quantity").alias("q"))
    pair = unfold(sums).groupBy("variant", "l_partkey", "l_suppkey").agg(F.sum("q").alias("q"))
    whole = pair.groupBy("variant", "l_partkey").agg(F.sum("q").alias("all_q"))
    suppliers = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    return (
        pair.join(whole, ["variant", "l_partkey"])
        .where(c("q") > 0.5 * c("all_q"))
        .select("variant", "l_suppkey")
        .distinct()
        .join(suppliers, c("l_suppkey") == c("s_suppkey"))
        .where(c("n_name") == setting([s["n"] for s in settings]))
        .select("variant", "s_suppkey", "s_name")
    )


# ---------------------------------------------------------------- 21


@family(
    "tpch_q21",
    [{"n": "NATION_3"}, {"n": "NATION_9"}, {"n": "NATION_21"}],
    f"""
WITH p AS (SELECT l_orderkey, l_suppkey, bool_or({LATE_SQL}) AS late FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE o_orderstatus = 'F' GROUP BY ALL),
 o AS (SELECT l_orderkey, max(CASE WHEN late THEN l_suppkey END) AS k FROM p GROUP BY l_orderkey
  HAVING count(*) > 1 AND count(*) FILTER (late) = 1)
SELECT s_name, count(*) AS numwait FROM o JOIN supplier ON s_suppkey = k JOIN nation ON n_nationkey = s_nationkey
WHERE n_name = '{{n}}' GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
)
def waiting_suppliers(t, settings):
    filled = t.orders.where(c("o_orderstatus") == "F")
    # one row per order and supplier, then one per order: no self join
    pairs = (
        t.lineitem.join(filled, line_order())
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.bool_or(late()).alias("late"))
    )
    sole = (
        pairs.groupBy("l_orderkey")
        .agg(
            F.count("*").alias("suppliers"),
            F.count_if("late").alias("n_late"),
            F.max(F.when(c("late"), c("l_suppkey"))).alias("s_suppkey"),
        )
        .where((c("suppliers") > 1) & (c("n_late") == 1))
    )
    counts = sole.groupBy("s_suppkey").agg(F.count("*").alias("numwait"))
    homes = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    named = unfold(tagged(counts.join(homes, "s_suppkey"), [c("n_name") == s["n"] for s in settings]))
    return top_per_variant(named.select("variant", "s_name", "numwait"), 100, F.desc("numwait"), "s_name")


# ---------------------------------------------------------------- 22


@query(
    "tpch_q22",
    """
WITH k AS (SELECT * FROM customer WHERE c_nationkey IN (13, 1, 23, 9, 10, 18, 17)),
 m AS (SELECT round(sum(c_acctbal), 2) / count(*) AS v FROM k WHERE c_acctbal > 0)
SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM k JOIN nation ON n_nationkey = c_nationkey
WHERE c_acctbal > (SELECT v FROM m) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
 AND o_orderdate >= DATE '2000-01-01') GROUP BY n_name""",
)
def sales_opportunity(t):
    some = t.customer.where(c("c_nationkey").isin(13, 1, 23, 9, 10, 18, 17))
    typical = some.where(c("c_acctbal") > 0).agg(mean("c_acctbal").alias("v")).scalar()
    recent = t.orders.where(c("o_orderdate") >= day("2000-01-01"))
    return (
        some.where(c("c_acctbal") > typical)
        .join(recent, c("c_custkey") == c("o_custkey"), "left_anti")
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("customers"), total("c_acctbal").alias("balance"))
        .join(t.nation, c("c_nationkey") == c("n_nationkey"))
        .select("n_name", "customers", "balance")
    )
