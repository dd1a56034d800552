"""Seeded databases of three schemas, any number of snapshots in one job.

``seeds`` has one ``snapshot`` per database. Every value is a draw on (snapshot, field, ids), so a table can be
made without the tables it refers to, on any partitioning. Rows per database vary with the draw, and
the edge rows the checks rely on are kept: missing countries, repeated names, an empty category or
department, zero quantities, open sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.draws import draw
from assayer.functions.numeric import day
from assayer.session import spread

c = F.col

# fixed values: the words and weights of the three schemas
FIRST_NAMES = ["Asha", "Ben", "Chen", "Dev", "Eva", "Fatima", "Gus"]
INITIALS = ["K", "L", "M"]
COUNTRIES = ["IN", "US", "DE", "BR", "JP"]  # a sixth of the customers has none
CATEGORIES = ["books", "toys", "kitchen", "garden"]
STATUS_WEIGHTS = {"paid": 8, "refunded": 1, "cancelled": 1}
DEPARTMENTS = [
    (1, "Corporate", None), (2, "Engineering", 1), (3, "Sales", 1), (4, "Platform", 2), (5, "Apps", 2), (6, "Field", 3),
]
SOMETIMES = (7, "Research", 2)
STAFF_NAMES = ["Ira", "Jon", "Kai", "Lee", "Mo", "Nia"]
STAFF_INITIALS = ["P", "Q", "R", "S"]
PLAN_WEIGHTS = {"free": 6, "pro": 3, "team": 1}
DEVICES = ["ios", "android", "web"]
KIND_WEIGHTS = {"view": 7, "click": 3, "purchase": 1}


def word(words: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), number.cast("int"))


def weighted(weights: dict[str, int], *keys) -> Column:
    number, below, choice = draw(sum(weights.values()), *keys), 0, None
    for name, weight in weights.items():
        below += weight
        choice = F.when(number < below, name) if choice is None else choice.when(number < below, name)
    return choice


def upto(low: int, high: int, *keys) -> Column:
    """A whole number from low to high, both included."""
    return (low + draw(high - low + 1, *keys)).cast("int")


def rows(df: DataFrame, name: str, n: Column) -> DataFrame:
    """``n`` rows numbered from 1; none when ``n`` is 0. The number is drawn once, not for every row made."""
    counted = df.withColumn("_n", n)
    return counted.withColumn(name, F.explode(F.sequence(F.lit(1), F.greatest("_n", F.lit(1))))).where(c(name) <= c("_n")).drop("_n")


def money(cents: Column, digits: int = 10) -> Column:
    return (cents.cast(f"decimal({digits},0)") / 100).cast(f"decimal({digits},2)")


S = "snapshot"


def n_customers(scale: int) -> Column:
    return (upto(40, 60, "customers", c(S)) * scale).cast("int")


def n_products(scale: int) -> Column:
    return (upto(12, 20, "products", c(S)) * scale).cast("int")


def product_cents(product: Column) -> Column:
    return 200 + draw(11801, "price", c(S), product)


def shop(seeds: DataFrame, scale: int = 1) -> dict[str, DataFrame]:
    i = c("id")
    customers = rows(seeds.select(S), "id", n_customers(scale)).select(
        S,
        "id",
        F.concat(
            word(FIRST_NAMES, draw(7, "name", c(S), i)),
            F.when(draw(2, "initial?", c(S), i) == 0, F.concat(F.lit(" "), word(INITIALS, draw(3, "initial", c(S), i))))
            .otherwise(""),
        ).alias("name"),
        word(COUNTRIES, draw(6, "country", c(S), i)).alias("country"),
        F.date_add(day("2024-01-01"), upto(0, 400, "signup", c(S), i)).alias("signup_date"),
    )
    category = word(CATEGORIES, draw(4, "category", c(S), i))
    no_garden = draw(2, "empty category", c(S)) == 0
    products = rows(seeds.select(S), "id", n_products(scale)).select(
        S,
        "id",
        F.concat(F.lit("p"), i.cast("string")).alias("name"),
        F.when(no_garden & (category == "garden"), "kitchen").otherwise(category).alias("category"),
        money(product_cents(i)).alias("unit_price"),
    )
    numbered = rows(seeds.select(S), "id", (upto(150, 260, "orders", c(S)) * scale).cast("int"))
    orders = numbered.select(
        S,
        "id",
        (1 + draw(n_customers(scale).cast("bigint"), "buyer", c(S), i)).cast("int").alias("customer_id"),
        F.date_add(day("2024-01-01"), upto(0, 500, "ordered", c(S), i)).alias("order_date"),
        weighted(STATUS_WEIGHTS, "status", c(S), i).alias("status"),
    )
    line = (c(S), c("order_id"), c("line"))
    product = (1 + draw(n_products(scale).cast("bigint"), "item", *line)).cast("int")
    percent = F.get(F.array(*[F.lit(p) for p in (100, 100, 90, 110)]), draw(4, "sale", *line).cast("int"))
    odd = F.get(F.array(*[F.lit(q) for q in (0, 1, 1, 2, 3, 5)]), draw(6, "odd quantity", *line).cast("int"))
    lines = rows(numbered.withColumnRenamed("id", "order_id"), "line", upto(1, 4, "lines", c(S), c("order_id")))
    order_items = lines.withColumn("product_id", product).select(
        S,
        "order_id",
        "product_id",
        F.when(draw(100, "odd?", *line) < 5, odd).otherwise(upto(1, 5, "quantity", *line)).alias("quantity"),
        money(F.floor((product_cents(c("product_id")) * percent + 50) / 100)).alias("unit_price"),
    )
    return {"customers": customers, "products": products, "orders": orders, "order_items": order_items}


def hr(seeds: DataFrame, scale: int = 1) -> dict[str, DataFrame]:
    known = F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(p).cast("int").alias("parent_id"))
        for i, n, p in [*DEPARTMENTS, SOMETIMES]
    ])
    extra = draw(2, "empty department", c(S)) == 0
    departments = seeds.select(S, extra.alias("extra"), F.inline(known)).where(
        c("extra") | (c("id") != SOMETIMES[0])
    ).drop("extra")
    i = c("id")
    staffed = rows(seeds.select(S), "id", (upto(45, 70, "staff", c(S)) * scale).cast("int"))
    employees = (
        staffed.select(
            S,
            "id",
            F.concat(
                word(STAFF_NAMES, draw(6, "staff name", c(S), i)),
                F.lit(" "),
                word(STAFF_INITIALS, draw(4, "staff initial", c(S), i)),
            ).alias("name"),
            upto(2, 6, "department", c(S), i).alias("dept_id"),
            F.when(
                (i > 1) & (draw(10, "led", c(S), i) > 0),
                (1 + draw(F.greatest(i - 1, F.lit(1)).cast("bigint"), "manager", c(S), i)).cast("int"),
            ).alias("manager_id"),
            F.date_add(day("2018-01-01"), upto(0, 2200, "hired", c(S), i)).alias("hire_date"),
        )
        .withColumn(
            "left_date",
            F.when(draw(5, "left", c(S), i) == 0, F.date_add("hire_date", upto(30, 1500, "stayed", c(S), i))),
        )
    )
    # the raise chain, in hundreds, rounded at every step
    amounts = [upto(300, 900, "salary", c(S), i).cast("bigint")]
    for k in (1, 2, 3):
        factor = 1000 + draw(151, "raise", c(S), i, k)
        amounts.append(F.floor((amounts[-1] * factor + 500) / 1000))
    steps = F.array(*[
        F.struct(F.lit(k).alias("k"), F.date_add("hire_date", 365 * k).alias("effective_from"), a.alias("hundreds"))
        for k, a in enumerate(amounts)
    ])
    there = c("left_date").isNull() | (c("effective_from") <= c("left_date")) | (c("k") == 0)
    salaries = (
        employees.select(S, "id", "left_date", upto(0, 3, "raises", c(S), i).alias("raises"), F.inline(steps))
        .where((c("k") <= c("raises")) & there)
        .select(S, c("id").alias("employee_id"), "effective_from", money(c("hundreds") * 10000, 12).alias("amount"))
    )
    y = c("review_year")
    reviews = (
        employees.withColumn("review_year", F.explode(F.sequence(F.lit(2019), F.lit(2024))))
        .where(
            (draw(10, "reviewed", c(S), i, y) < 7)
            & (F.year("hire_date") <= y)
            & (c("left_date").isNull() | (F.year("left_date") >= y))
        )
        .select(S, c("id").alias("employee_id"), "review_year", upto(1, 5, "score", c(S), i, y).alias("score"))
    )
    return {"departments": departments, "employees": employees, "salaries": salaries, "reviews": reviews}


def after(ts: Column, number: Column, unit: str) -> Column:
    return F.timestamp_add(unit, number.cast("int"), ts)


def events(seeds: DataFrame, scale: int = 1) -> dict[str, DataFrame]:
    i = c("id")
    start = F.lit("2025-03-01 00:00:00").cast("timestamp_ntz")
    users = rows(seeds.select(S), "id", (upto(30, 50, "users", c(S)) * scale).cast("int")).select(
        S,
        "id",
        weighted(PLAN_WEIGHTS, "plan", c(S), i).alias("plan"),
        after(start, upto(0, 1440, "created", c(S), i), "HOUR").alias("created_at"),
    )
    owned = rows(users.withColumnRenamed("id", "user_id"), "k", upto(0, 8, "sessions", c(S), c("user_id")))
    one = (c(S), c("user_id"), c("k"))
    sessions = (
        owned.withColumn("started_at", after(c("created_at"), upto(1, 2160, "started", *one), "HOUR"))
        .select(
            S,
            (c("user_id") * 10 + c("k")).alias("id"),
            "user_id",
            "started_at",
            F.when(
                draw(10, "closed", *one) < 9, after(c("started_at"), upto(1, 180, "length", *one), "MINUTE")
            ).alias("ended_at"),
            word(DEVICES, draw(3, "device", *one)).alias("device"),
        )
    )
    at = (c(S), c("session_id"), c("n"))
    steps = rows(
        sessions.select(S, c("id").alias("session_id"), "started_at"), "n", upto(1, 12, "events", c(S), c("session_id"))
    ).withColumn("gap", upto(5, 600, "gap", *at))
    so_far = F.sum("gap").over(Window.partitionBy(S, "session_id").orderBy("n"))  # at most 12 rows
    rows_ = steps.withColumn("kind", weighted(KIND_WEIGHTS, "kind", *at)).select(
        S,
        "session_id",
        after(c("started_at"), so_far, "SECOND").alias("ts"),
        "kind",
        F.when(c("kind") == "purchase", (100 + draw(19901, "value", *at)) / 100.0).alias("value"),
    )
    return {"users": users, "sessions": sessions, "events": rows_}


SCHEMAS = {"shop": shop, "hr": hr, "events": events}


def generate(seeds: DataFrame, schema: str, scale: int = 1) -> dict[str, DataFrame]:
    """The tables of ``schema`` for every snapshot in ``seeds``; ``scale`` multiplies the rows of a database.

    Seeds are dealt out by snapshot, so that all cores make rows and what is grouped by snapshot stays where it is made.
    """
    return SCHEMAS[schema](spread(seeds, S), scale)
