"""Three small schemas (shop, hr, events) over the given tables, in four snapshots at once.

Facts are split over the snapshots by their key; dimensions are in every snapshot, with attributes drawn per
snapshot. Every table leads with ``snapshot``, so one job answers a task on all snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.draws import draw
from assayer.functions.draws import sql_ticket as tk
from assayer.functions.numeric import day
from assayer.operators.sessions import session_slots, slot_of

c = F.col
SNAPSHOTS = (0, 101, 202, 303)
GAP = 86_400


def snapshot_of(key: str) -> Column:
    return one_of_snapshots(c(key) % 4)


def one_of_snapshots(number: Column | str) -> Column:
    number = c(number) if isinstance(number, str) else number
    return F.element_at(F.array(*[F.lit(s) for s in SNAPSHOTS]), number.cast("int") + 1)


def in_every_snapshot(df: DataFrame) -> DataFrame:
    """A cross join and no ``explode``: the planner would take that for as many rows as it read, and send them around."""
    numbers = df.sparkSession.range(len(SNAPSHOTS)).select(one_of_snapshots("id").alias("snapshot"))
    return df.crossJoin(numbers)


def one_of(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), number.cast("int") + 1)


SNAP_SQL = "sn AS (SELECT unnest([0, 101, 202, 303]) AS snapshot)"


def sql_snapshot(key: str) -> str:
    return f"[0, 101, 202, 303][1 + {key} % 4]"


# ---------------------------------------------------------------- shop

SHOP_SQL = f"""{SNAP_SQL},
customers AS (SELECT snapshot, c_custkey AS id, c_name AS name, CASE WHEN {tk("'country'", "snapshot", "c_custkey")} % 6 > 0
   THEN 'N' || c_nationkey END AS country FROM customer, sn),
products AS (SELECT snapshot, p_partkey AS id, p_name AS name, p_type AS category FROM part, sn),
sales AS (SELECT {sql_snapshot("o_orderkey")} AS snapshot, o_orderkey AS id, o_custkey AS customer_id,
  CAST(o_orderdate AS DATE) AS order_date, CASE WHEN {tk("'status'", "o_orderkey")} % 10 < 8 THEN 'paid'
   WHEN {tk("'status'", "o_orderkey")} % 10 = 8 THEN 'refunded' ELSE 'cancelled' END AS status FROM orders),
items AS (SELECT {sql_snapshot("l_orderkey")} AS snapshot, l_orderkey AS order_id, l_partkey AS product_id,
  CASE WHEN {tk("'quantity'", "l_orderkey", "l_linenumber", "l_partkey")} % 20 = 0 THEN 0 ELSE CAST(l_quantity AS INTEGER)
   END AS quantity, floor(l_extendedprice / l_quantity) AS unit_price FROM lineitem)
"""


def shop(t) -> dict[str, DataFrame]:
    customers = in_every_snapshot(t.customer).select(
        "snapshot",
        c("c_custkey").alias("id"),
        c("c_name").alias("name"),
        F.when(
            draw(6, "country", c("snapshot"), c("c_custkey")) > 0, F.concat(F.lit("N"), c("c_nationkey").cast("string"))
        ).alias("country"),
        F.date_add(day("2024-01-01"), draw(400, "signup", c("snapshot"), c("c_custkey")).cast("int")).alias("signup_date"),
    )
    products = in_every_snapshot(t.part).select(
        "snapshot",
        c("p_partkey").alias("id"),
        c("p_name").alias("name"),
        c("p_type").alias("category"),
        F.floor("p_retailprice").cast("double").alias("unit_price"),
    )
    turn = draw(10, "status", c("o_orderkey"))
    orders = t.orders.select(
        snapshot_of("o_orderkey").alias("snapshot"),
        c("o_orderkey").alias("id"),
        c("o_custkey").alias("customer_id"),
        c("o_orderdate").cast("date").alias("order_date"),
        F.when(turn < 8, "paid").when(turn == 8, "refunded").otherwise("cancelled").alias("status"),
    )
    nothing = draw(20, "quantity", c("l_orderkey"), c("l_linenumber"), c("l_partkey")) == 0
    items = t.lineitem.select(
        snapshot_of("l_orderkey").alias("snapshot"),
        c("l_orderkey").alias("order_id"),
        c("l_partkey").alias("product_id"),
        F.when(nothing, 0).otherwise(c("l_quantity").cast("int")).alias("quantity"),
        F.floor(c("l_extendedprice") / c("l_quantity")).cast("double").alias("unit_price"),
    )
    return {"customers": customers, "products": products, "orders": orders, "order_items": items}


# ---------------------------------------------------------------- hr

HR_SQL = f"""{SNAP_SQL},
departments AS (SELECT snapshot, 1 AS id, 'Corporate' AS name, NULL::INTEGER AS parent_id FROM sn
  UNION ALL SELECT snapshot, 2 + r_regionkey, r_name, 1 FROM region, sn
  UNION ALL SELECT snapshot, 100 + n_nationkey, n_name, 2 + n_regionkey FROM nation, sn),
emp0 AS (SELECT snapshot, c_custkey AS id, c_name AS name, 100 + c_nationkey AS dept_id,
  CASE WHEN c_custkey > 0 AND {tk("'lead'", "snapshot", "c_custkey")} % 10 > 0
   THEN {tk("'boss'", "snapshot", "c_custkey")} % c_custkey END AS manager_id,
  DATE '2018-01-01' + CAST({tk("'hire'", "snapshot", "c_custkey")} % 2200 AS INTEGER) AS hire_date FROM customer, sn),
employees AS (SELECT *, CASE WHEN {tk("'left'", "snapshot", "id")} % 5 = 0
   THEN hire_date + CAST(30 + {tk("'stay'", "snapshot", "id")} % 1470 AS INTEGER) END AS left_date FROM emp0),
salaries AS (SELECT {sql_snapshot("o_orderkey")} AS snapshot, o_custkey AS employee_id,
  CAST(o_orderdate AS DATE) AS effective_from, max(floor(o_totalprice)) AS amount FROM orders GROUP BY ALL),
reviews AS (SELECT {sql_snapshot("o_orderkey")} AS snapshot, o_custkey AS employee_id,
  CAST(year(o_orderdate) + 23 AS INTEGER) AS review_year, min(CAST(o_orderpriority[1] AS INTEGER)) AS score
  FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
"""


def hr(t) -> dict[str, DataFrame]:
    root = t.spark.range(1).select(
        F.lit(1).alias("id"), F.lit("Corporate").alias("name"), F.lit(None).cast("int").alias("parent_id")
    )
    regions = t.region.select((c("r_regionkey") + 2).alias("id"), c("r_name").alias("name"), F.lit(1).alias("parent_id"))
    nations = t.nation.select(
        (c("n_nationkey") + 100).alias("id"), c("n_name").alias("name"), (c("n_regionkey") + 2).alias("parent_id")
    )
    departments = in_every_snapshot(root.unionByName(regions).unionByName(nations)).select(
        "snapshot", "id", "name", "parent_id"
    )
    who = (c("snapshot"), c("c_custkey"))
    led = (c("c_custkey") > 0) & (draw(10, "lead", *who) > 0)
    boss = draw(F.greatest(c("c_custkey"), F.lit(1)), "boss", *who)
    hired = F.date_add(day("2018-01-01"), draw(2200, "hire", *who).cast("int"))
    employees = (
        in_every_snapshot(t.customer)
        .select(
            "snapshot",
            c("c_custkey").alias("id"),
            c("c_name").alias("name"),
            (c("c_nationkey") + 100).alias("dept_id"),
            F.when(led, boss).alias("manager_id"),
            hired.alias("hire_date"),
        )
        .withColumn(
            "left_date",
            F.when(
                draw(5, "left", c("snapshot"), c("id")) == 0,
                F.date_add("hire_date", (30 + draw(1470, "stay", c("snapshot"), c("id"))).cast("int")),
            ),
        )
    )
    split = t.orders.withColumn("snapshot", snapshot_of("o_orderkey"))
    salaries = split.groupBy(
        "snapshot", c("o_custkey").alias("employee_id"), c("o_orderdate").cast("date").alias("effective_from")
    ).agg(F.max(F.floor("o_totalprice").cast("double")).alias("amount"))
    reviews = (
        split.where(c("o_orderstatus") == "F")
        .groupBy(
            "snapshot",
            c("o_custkey").alias("employee_id"),
            (F.year("o_orderdate") + 23).cast("int").alias("review_year"),
        )
        .agg(F.min(F.substring("o_orderpriority", 1, 1).cast("int")).alias("score"))
    )
    return {"departments": departments, "employees": employees, "salaries": salaries, "reviews": reviews}


# ---------------------------------------------------------------- events

EVENTS_SQL = f"""{SNAP_SQL},
users AS (SELECT snapshot, c_custkey AS id, CASE WHEN {tk("'plan'", "snapshot", "c_custkey")} % 10 < 6 THEN 'free'
  WHEN {tk("'plan'", "snapshot", "c_custkey")} % 10 < 9 THEN 'pro' ELSE 'team' END AS plan FROM customer, sn),
ev0 AS (SELECT {sql_snapshot("event_id")} AS snapshot, * FROM events),
ev1 AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {GAP * 1_000_000} THEN 1
  ELSE 0 END AS opens FROM ev0 WINDOW w AS (PARTITION BY snapshot, user_id ORDER BY ts, event_id)),
ev2 AS (SELECT *, sum(opens) OVER (PARTITION BY snapshot, user_id ORDER BY ts, event_id) AS session_no FROM ev1),
ses0 AS (SELECT snapshot, user_id, session_no, min(event_id) AS id, min(ts) AS started_at, max(ts) AS last_at FROM ev2
  GROUP BY ALL),
sessions AS (SELECT snapshot, id, user_id, started_at, CASE WHEN {tk("'end'", "snapshot", "id")} % 10 > 0 THEN last_at END
   AS ended_at, ['ios', 'android', 'web'][1 + {tk("'device'", "snapshot", "id")} % 3] AS device FROM ses0),
evs AS (SELECT ev2.snapshot, ses0.id AS session_id, ts, event_type AS kind,
   CASE WHEN event_type = 'purchase' THEN value END AS value FROM ev2 JOIN ses0 USING (snapshot, user_id, session_no))
"""


def events(t) -> dict[str, DataFrame]:
    turn = draw(10, "plan", c("snapshot"), c("c_custkey"))
    users = in_every_snapshot(t.customer).select(
        "snapshot",
        c("c_custkey").alias("id"),
        F.when(turn < 6, "free").when(turn < 9, "pro").otherwise("team").alias("plan"),
    )
    raw = t.events.withColumn("snapshot", snapshot_of("event_id"))
    owner = ["snapshot", "user_id"]
    slots = session_slots(raw, owner, "ts", GAP, [F.min("event_id").alias("first_id")])
    spans = slots.groupBy(*owner, "session_no").agg(
        F.min("first_id").alias("id"), F.min("lo").alias("started_at"), F.max("hi").alias("last_at")
    )
    sessions = spans.select(
        "snapshot",
        "id",
        "user_id",
        "started_at",
        F.when(draw(10, "end", c("snapshot"), c("id")) > 0, c("last_at")).alias("ended_at"),
        one_of(["ios", "android", "web"], draw(3, "device", c("snapshot"), c("id"))).alias("device"),
    )
    session_ids = slots.select(*owner, "slot", "session_no").join(
        spans.select(*owner, "session_no", c("id").alias("session_id")), [*owner, "session_no"]
    )
    rows = raw.withColumn("slot", slot_of("ts", GAP)).join(session_ids, [*owner, "slot"]).select(
        "snapshot",
        "session_id",
        "ts",
        c("event_type").alias("kind"),
        F.when(c("event_type") == "purchase", c("value")).alias("value"),
    )
    return {"users": users, "sessions": sessions, "events": rows}
