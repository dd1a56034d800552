"""The 27 question templates, each for every setting of its parameters and every snapshot in one job.

A function takes the tables of a database (each with a leading ``snapshot``) and returns the parameters as
columns beside the answer. A single task is a filter on them, which reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.numeric import mean, total
from assayer.operators.metrics import ratio
from assayer.operators.sessions import micros
from assayer.operators.trees import top_ancestors

c = F.col
DB = dict[str, DataFrame]


def any_of(values: list) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * ratio(part, whole), 2)


def ranked(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first ``k`` rows per group with their ``place``; the limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(c("place") <= k)


# ---------------------------------------------------------------- shop


def order_lines(db: DB) -> DataFrame:
    items = db["order_items"].withColumn("line_value", c("quantity") * c("unit_price"))
    orders = db["orders"].withColumnRenamed("id", "order_id")
    return items.join(orders, ["snapshot", "order_id"])


def status_counts(db: DB) -> DataFrame:
    return db["orders"].groupBy("snapshot", "status").agg(F.count("*").alias("n"))


def line_values(db: DB) -> DataFrame:
    """Sum, mean and number of lines by category and by country."""
    lines = order_lines(db)

    def by(names, key, label, kind):
        summed = lines.groupBy("snapshot", "status", key).agg(
            F.sum("line_value").alias("v"), F.count("*").alias("k")
        )
        named = summed.join(names.withColumnRenamed("id", key), ["snapshot", key]).where(c(label).isNotNull())
        return named.groupBy("snapshot", "status", F.lit(kind).alias("grouping"), c(label).alias("label")).agg(
            total("v").alias("total"), ratio(F.sum("v"), F.sum("k")).alias("mean"), F.sum("k").alias("n")
        )

    return by(db["products"], "product_id", "category", "category").unionByName(
        by(db["customers"], "customer_id", "country", "country")
    )


def top_customers(db: DB, k: int = 3) -> DataFrame:
    sums = order_lines(db).groupBy("snapshot", "status", "customer_id").agg(total("line_value").alias("total"))
    return ranked(sums, ["snapshot", "status"], k, F.desc("total"), "customer_id")


def orders_with_quantity(db: DB, quantities=(0, 1, 5)) -> DataFrame:
    hit = db["order_items"].where(c("quantity").isin(*quantities)).select("snapshot", "order_id", "quantity").distinct()
    orders = db["orders"].select("snapshot", c("id").alias("order_id"), "status")
    return hit.join(orders, ["snapshot", "order_id"]).groupBy("snapshot", "status", "quantity").agg(
        F.count("*").alias("n")
    )


def order_years(db: DB) -> DataFrame:
    """Customers by the year of their first and of their latest order."""
    ends = db["orders"].groupBy("snapshot", "status", "customer_id").agg(
        F.min("order_date").alias("first"), F.max("order_date").alias("latest")
    )
    long = ends.select("snapshot", "status", F.inline(F.array(*[
        F.struct(F.lit(e).alias("end"), F.year(e).cast("int").alias("yr")) for e in ("first", "latest")
    ])))
    return long.groupBy("snapshot", "status", "end", "yr").agg(F.count("*").alias("n"))


def order_values(db: DB, floors=(5, 10, 15)) -> DataFrame:
    """Mean order value per country with at least ``floor`` orders that have lines."""
    values = order_lines(db).groupBy("snapshot", "status", "order_id", "customer_id").agg(F.sum("line_value").alias("v"))
    named = values.join(
        db["customers"].select("snapshot", c("id").alias("customer_id"), "country"), ["snapshot", "customer_id"]
    ).where(c("country").isNotNull())
    means = named.groupBy("snapshot", "status", "country").agg(mean("v").alias("mean"), F.count("*").alias("n"))
    return means.withColumn("floor", any_of(list(floors))).where(c("n") >= c("floor"))


def best_products(db: DB) -> DataFrame:
    sums = order_lines(db).groupBy("snapshot", "status", "product_id").agg(total("line_value").alias("v"))
    named = sums.join(db["products"].withColumnRenamed("id", "product_id"), ["snapshot", "product_id"])
    return ranked(named, ["snapshot", "status", "category"], 1, F.desc("v"), "product_id").select(
        "snapshot", "status", "category", "name"
    )


def repeat_within(db: DB, places=(2, 3), days=(14, 30, 60, 90)) -> DataFrame:
    """Customers whose n-th order came within some days of their first."""
    first = ranked(db["orders"], ["snapshot", "status", "customer_id"], max(places), "order_date", "id")
    dated = first.groupBy("snapshot", "status", "customer_id").agg(
        F.min(F.when(c("place") == 1, c("order_date"))).alias("d1"),
        *[F.min(F.when(c("place") == p, c("order_date"))).alias(f"d{p}") for p in places],
    )
    counts = dated.groupBy("snapshot", "status").agg(
        *[F.count_if(F.date_diff(f"d{p}", "d1") <= d).alias(f"n{p}_{d}") for p in places for d in days]
    )
    cases = [
        F.struct(F.lit(p).alias("nth"), F.lit(d).alias("days"), c(f"n{p}_{d}").alias("n")) for p in places for d in days
    ]
    return counts.select("snapshot", "status", F.inline(F.array(*cases)))


def repeat_share(db: DB, least=(2, 3, 4)) -> DataFrame:
    per = db["orders"].groupBy("snapshot", "status", "customer_id").agg(F.count("*").alias("n"))
    counts = per.groupBy("snapshot", "status").agg(
        F.count("*").alias("whole"), *[F.count_if(c("n") >= m).alias(f"m{m}") for m in least]
    )
    cases = [F.struct(F.lit(m).alias("least"), percent(c(f"m{m}"), c("whole")).alias("pct")) for m in least]
    return counts.select("snapshot", "status", F.inline(F.array(*cases)))


# ---------------------------------------------------------------- hr


def staff(db: DB) -> DataFrame:
    state = F.when(c("left_date").isNull(), "current").otherwise("former")
    return db["employees"].withColumn("state", state)


def staff_counts(db: DB) -> DataFrame:
    return staff(db).groupBy("snapshot", "state").agg(F.count("*").alias("n"))


def staff_by_department(db: DB) -> DataFrame:
    """Head counts per department; departments without staff count 0."""
    heads = staff(db).groupBy("snapshot", c("dept_id").alias("id"), "state").agg(F.count("*").alias("k"))
    every = db["departments"].select("snapshot", "id", "name").withColumn("state", any_of(["current", "former"]))
    return (
        every.join(heads, ["snapshot", "id", "state"], "left")
        .groupBy("snapshot", "state", "name")
        .agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    )


def salary_ends(db: DB) -> DataFrame:
    """First and current salary of each employee."""
    return db["salaries"].groupBy("snapshot", "employee_id").agg(
        F.max_by("amount", "effective_from").alias("current_amount"),
        F.min_by("amount", "effective_from").alias("first_amount"),
    )


def paid_staff(db: DB) -> DataFrame:
    return staff(db).join(salary_ends(db).withColumnRenamed("employee_id", "id"), ["snapshot", "id"])


def salary_levels(db: DB) -> DataFrame:
    v = "current_amount"
    return paid_staff(db).groupBy("snapshot", "state").agg(
        F.round(mean(v), 2).alias("mean"), F.max(v).alias("highest"), F.min(v).alias("lowest")
    )


def best_paid_department(db: DB) -> DataFrame:
    means = paid_staff(db).groupBy("snapshot", "state", "dept_id").agg(
        F.sum("current_amount").alias("v"), F.count("*").alias("k")
    )
    named = means.join(db["departments"].select("snapshot", c("id").alias("dept_id"), "name"), ["snapshot", "dept_id"])
    levels = named.groupBy("snapshot", "state", "name").agg(ratio(F.sum("v"), F.sum("k")).alias("mean"))
    return ranked(levels, ["snapshot", "state"], 1, F.desc("mean"), "name").select("snapshot", "state", "name")


def review_scores(db: DB, years=(2020, 2021, 2022, 2023), floors=(2, 3, 5)) -> DataFrame:
    people = db["employees"].select("snapshot", c("id").alias("employee_id"), c("dept_id").alias("id"))
    scores = (
        db["reviews"].where(c("review_year").isin(*years))
        .join(people, ["snapshot", "employee_id"])
        .groupBy("snapshot", "review_year", "id")
        .agg(F.sum("score").alias("s"), F.count("*").alias("k"))
        .join(db["departments"].select("snapshot", "id", "name"), ["snapshot", "id"])
        .groupBy("snapshot", "review_year", "name")
        .agg(ratio(F.sum("s"), F.sum("k")).alias("mean"), F.sum("k").alias("n"))
    )
    return scores.withColumn("floor", any_of(list(floors))).where(c("n") >= c("floor"))


def top_managers(db: DB, k: int = 5) -> DataFrame:
    current = db["employees"].where(c("left_date").isNull())
    reports = current.where(c("manager_id").isNotNull()).groupBy("snapshot", c("manager_id").alias("id")).agg(
        F.count("*").alias("n")
    )
    managers = reports.join(current.select("snapshot", "id", "name"), ["snapshot", "id"])
    return ranked(managers, ["snapshot"], k, F.desc("n"), "id").select("snapshot", "place", "name", "n")


def largest_raise(db: DB) -> DataFrame:
    raises = paid_staff(db).withColumn("increase", c("current_amount") - c("first_amount"))
    return ranked(raises, ["snapshot", "state"], 1, F.desc("increase"), "id").select("snapshot", "state", "id", "increase")


def tree_headcount(db: DB, root: str = "Corporate") -> DataFrame:
    """Staff in each department right under the root and in all departments below it."""
    departments = db["departments"]
    roots = departments.where(c("name") == root).select("snapshot", c("id").alias("parent_id"), F.lit(True).alias("is_top"))
    nodes = departments.join(roots, ["snapshot", "parent_id"], "left").fillna(False, ["is_top"])
    tops = top_ancestors(nodes, ["snapshot"], "is_top")
    heads = staff(db).groupBy("snapshot", c("dept_id").alias("id"), "state").agg(F.count("*").alias("k"))
    every = tops.withColumn("state", any_of(["current", "former"])).join(heads, ["snapshot", "id", "state"], "left")
    names = departments.select("snapshot", c("id").alias("top_id"), "name")
    return (
        every.groupBy("snapshot", "state", "top_id")
        .agg(F.coalesce(F.sum("k"), F.lit(0)).alias("headcount"))
        .join(names, ["snapshot", "top_id"])
        .select("snapshot", "state", "name", "headcount")
    )


def early_leavers(db: DB, cuts=("2021-01-01", "2022-01-01", "2023-01-01"), days=(180, 365, 730)) -> DataFrame:
    hired = {cut: c("hire_date") < F.lit(cut).cast("date") for cut in cuts}
    gone = F.date_diff("left_date", "hire_date")
    counts = db["employees"].groupBy("snapshot").agg(
        *[F.count_if(hired[cut]).alias(f"h{i}") for i, cut in enumerate(cuts)],
        *[F.count_if(hired[cut] & (gone <= d)).alias(f"g{i}_{d}") for i, cut in enumerate(cuts) for d in days],
    )
    cases = [
        F.struct(
            F.lit(cut).cast("date").alias("cut"), F.lit(d).alias("days"), percent(c(f"g{i}_{d}"), c(f"h{i}")).alias("pct")
        )
        for i, cut in enumerate(cuts)
        for d in days
    ]
    return counts.select("snapshot", F.inline(F.array(*cases)))


# ---------------------------------------------------------------- events


def session_keys(db: DB, *columns: str) -> DataFrame:
    return db["sessions"].select("snapshot", c("id").alias("session_id"), *columns)


def kind_by_device(db: DB) -> DataFrame:
    counts = db["events"].groupBy("snapshot", "session_id", "kind").agg(F.count("*").alias("k"))
    return (
        counts.join(session_keys(db, "device"), ["snapshot", "session_id"])
        .groupBy("snapshot", "kind", "device")
        .agg(F.sum("k").alias("n"))
    )


def purchases_by_plan(db: DB) -> DataFrame:
    """Purchase value and users per plan; users without a purchase count."""
    spent = (
        db["events"].where(c("kind") == "purchase")
        .groupBy("snapshot", "session_id")
        .agg(F.sum("value").alias("v"))
        .join(session_keys(db, "user_id"), ["snapshot", "session_id"])
        .groupBy("snapshot", c("user_id").alias("id"))
        .agg(F.sum("v").alias("v"))
    )
    every = db["users"].join(spent, ["snapshot", "id"], "left")
    return every.groupBy("snapshot", "plan").agg(
        F.coalesce(total("v"), F.lit(0.0)).alias("total"), F.count("*").alias("users")
    )


def session_minutes(db: DB) -> DataFrame:
    """Closed sessions and their whole length by device."""
    closed = db["sessions"].where(c("ended_at").isNotNull())
    spent = F.sum(micros("ended_at") - micros("started_at"))
    return closed.groupBy("snapshot", "device").agg(spent.alias("us"), F.count("*").alias("k"))


def mean_minutes(df: DataFrame, *keys: str) -> DataFrame:
    minutes = ratio(F.sum("us"), F.sum("k")) / 60_000_000
    return df.groupBy("snapshot", *keys).agg(F.round(minutes, 2).alias("minutes"))


def silent_users(db: DB) -> DataFrame:
    active = db["sessions"].select("snapshot", c("user_id").alias("id"))
    return db["users"].join(active, ["snapshot", "id"], "left_anti").groupBy("snapshot", "plan").agg(
        F.count("*").alias("n")
    )


def first_sessions(db: DB) -> DataFrame:
    first = F.min_by(F.struct("id", "device"), F.struct("started_at", "id"))
    return db["sessions"].groupBy("snapshot", "user_id").agg(first.alias("f")).select(
        "snapshot", "user_id", c("f.id").alias("first_session"), c("f.device").alias("device")
    )


def first_devices(db: DB) -> DataFrame:
    users = db["users"].select("snapshot", c("id").alias("user_id"), "plan")
    return first_sessions(db).join(users, ["snapshot", "user_id"]).groupBy("snapshot", "plan", "device").agg(
        F.count("*").alias("n")
    )


def sessions_with_kind(db: DB, kinds=("view", "click", "purchase")) -> DataFrame:
    """Sessions by device, in all and with at least one event of a kind."""
    seen = db["events"].where(c("kind").isin(*kinds)).groupBy("snapshot", "session_id").agg(
        *[F.bool_or(c("kind") == k).alias(f"has_{k}") for k in kinds]
    )
    counts = (
        session_keys(db, "device").join(seen, ["snapshot", "session_id"], "left")
        .groupBy("snapshot", "device")
        .agg(F.count("*").alias("sessions"), *[F.count_if(c(f"has_{k}")).alias(k) for k in kinds])
    )
    cases = [F.struct(F.lit(k).alias("kind"), c(k).alias("hits")) for k in kinds]
    return counts.select("snapshot", "device", "sessions", F.inline(F.array(*cases)))


def session_sizes(db: DB) -> DataFrame:
    """Median, maximum and mean of the events per session."""
    sizes = db["events"].groupBy("snapshot", "session_id").agg(F.count("*").alias("n"))
    weighted = sizes.groupBy("snapshot", "n").agg(F.count("*").alias("k"))
    return weighted.groupBy("snapshot").agg(
        F.percentile("n", 0.5, c("k")).alias("median"),
        F.max("n").alias("most"),
        ratio(F.sum(c("n") * c("k")), F.sum("k")).alias("mean"),
    )


def late_starters(db: DB, kinds=("view", "click", "purchase")) -> DataFrame:
    """Users whose first event of a kind fell in a session after their first."""
    firsts = (
        db["events"].where(c("kind").isin(*kinds))
        .groupBy("snapshot", "kind", "session_id")
        .agg(F.min("ts").alias("ts"))
        .join(session_keys(db, "user_id"), ["snapshot", "session_id"])
        .groupBy("snapshot", "kind", "user_id")
        .agg(F.min_by("session_id", "ts").alias("at_session"))
    )
    users = db["users"].select("snapshot", c("id").alias("user_id"), "plan")
    late = firsts.join(first_sessions(db), ["snapshot", "user_id"]).where(c("at_session") != c("first_session"))
    return late.join(users, ["snapshot", "user_id"]).groupBy("snapshot", "plan", "kind").agg(F.count("*").alias("n"))


def busiest_period(db: DB, units=("week", "month")) -> DataFrame:
    periods = F.array(*[
        F.struct(F.lit(u).alias("unit"), F.date_trunc(u, "started_at").cast("date").alias("start")) for u in units
    ])
    active = db["sessions"].select("snapshot", "user_id", F.inline(periods)).distinct()
    counts = active.groupBy("snapshot", "unit", "start").agg(F.count("*").alias("n"))
    return ranked(counts, ["snapshot", "unit"], 1, F.desc("n"), "start").select("snapshot", "unit", "start", "n")
