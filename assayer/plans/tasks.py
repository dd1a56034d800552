"""The 27 question templates and the 30 fixed tasks on four snapshots at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import answers as q
from assayer.operators.metrics import ratio
from assayer.plans.databases import EVENTS_SQL, HR_SQL, SHOP_SQL, events, hr, shop
from assayer.registry import query

c = F.col

LINES_SQL = "lines AS (SELECT i.*, customer_id, order_date, status, quantity * unit_price AS lv FROM items i JOIN sales s ON s.snapshot = i.snapshot AND s.id = i.order_id)"
LAST_PAY_SQL = """cur AS (SELECT snapshot, employee_id, arg_max(amount, effective_from) AS cur_amount,
  arg_min(amount, effective_from) AS first_amount FROM salaries GROUP BY ALL),
st AS (SELECT *, CASE WHEN left_date IS NULL THEN 'current' ELSE 'former' END AS state FROM employees),
pay AS (SELECT st.*, cur_amount, first_amount FROM st JOIN cur ON cur.snapshot = st.snapshot AND cur.employee_id = st.id)"""
STATE_SQL = "st AS (SELECT *, CASE WHEN left_date IS NULL THEN 'current' ELSE 'former' END AS state FROM employees)"


def shop_q(name, sql):
    return lambda plan: query(name, f"WITH {SHOP_SQL}, {sql}" if sql.startswith("lines") else f"WITH {SHOP_SQL} {sql}")(
        lambda t: plan(shop(t))
    )


def hr_q(name, sql, with_pay=False, recursive=False):
    head = "WITH RECURSIVE" if recursive else "WITH"
    extra = LAST_PAY_SQL if with_pay else STATE_SQL
    return lambda plan: query(name, f"{head} {HR_SQL}, {extra} {sql}")(lambda t: plan(hr(t)))


def ev_q(name, sql):
    return lambda plan: query(name, f"WITH {EVENTS_SQL} {sql}")(lambda t: plan(events(t)))


# ---------------------------------------------------------------- shop templates

shop_q("tpl_shop_1", "SELECT snapshot, status, count(*) AS n FROM sales GROUP BY ALL")(q.status_counts)

shop_q(
    "tpl_shop_2",
    LINES_SQL
    + """ SELECT l.snapshot, status, 'category' AS grouping, category AS label, round(sum(lv), 2) AS total,
  sum(lv) / count(*) AS mean, count(*) AS n FROM lines l JOIN products p ON p.snapshot = l.snapshot AND p.id = product_id
  GROUP BY ALL
UNION ALL SELECT l.snapshot, status, 'country', country, round(sum(lv), 2), sum(lv) / count(*), count(*)
  FROM lines l JOIN customers k ON k.snapshot = l.snapshot AND k.id = customer_id WHERE country IS NOT NULL GROUP BY ALL""",
)(q.line_values)

TOP_SQL = """ SELECT snapshot, status, customer_id, round(sum(lv), 2) AS total, CAST(row_number() OVER (
  PARTITION BY snapshot, status ORDER BY round(sum(lv), 2) DESC, customer_id) AS INTEGER) AS place FROM lines
  GROUP BY snapshot, status, customer_id QUALIFY place <= 3"""
shop_q("tpl_shop_3", LINES_SQL + TOP_SQL)(q.top_customers)

shop_q(
    "tpl_shop_4",
    """SELECT s.snapshot, status, quantity, count(DISTINCT s.id) AS n FROM sales s JOIN items i ON i.snapshot = s.snapshot
  AND i.order_id = s.id WHERE quantity IN (0, 1, 5) GROUP BY ALL""",
)(q.orders_with_quantity)

shop_q(
    "tpl_shop_5",
    """, f AS (SELECT snapshot, status, customer_id, min(order_date) AS lo, max(order_date) AS hi FROM sales GROUP BY ALL)
SELECT snapshot, status, 'first' AS "end", CAST(year(lo) AS INTEGER) AS yr, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT snapshot, status, 'latest', CAST(year(hi) AS INTEGER), count(*) FROM f GROUP BY ALL""",
)(q.order_years)

VALUES_SQL = """, ov AS (SELECT snapshot, status, order_id, customer_id, sum(lv) AS v FROM lines GROUP BY ALL),
 cv AS (SELECT ov.snapshot, status, country, round(sum(v), 2) / count(*) AS mean, count(*) AS n FROM ov JOIN customers k
  ON k.snapshot = ov.snapshot AND k.id = customer_id WHERE country IS NOT NULL GROUP BY ALL) """
shop_q(
    "tpl_shop_6",
    LINES_SQL + VALUES_SQL + "SELECT * FROM (SELECT *, unnest([5, 10, 15]) AS floor FROM cv) WHERE n >= floor",
)(q.order_values)

BEST_SQL = """, r AS (SELECT l.snapshot, status, category, p.id, name, round(sum(lv), 2) AS v FROM lines l
  JOIN products p ON p.snapshot = l.snapshot AND p.id = product_id GROUP BY ALL) """
shop_q(
    "tpl_shop_7",
    LINES_SQL + BEST_SQL + """SELECT snapshot, status, category, name FROM r
QUALIFY row_number() OVER (PARTITION BY snapshot, status, category ORDER BY v DESC, id) = 1""",
)(q.best_products)

RANKED_SQL = """, r AS (SELECT *, row_number() OVER (PARTITION BY snapshot, status, customer_id ORDER BY order_date, id) AS rn
  FROM sales), f AS (SELECT a.snapshot, a.status, b.rn AS nth, b.order_date - a.order_date AS gap FROM r a JOIN r b
  USING (snapshot, status, customer_id) WHERE a.rn = 1 AND b.rn IN (2, 3)) """
shop_q(
    "tpl_shop_8",
    RANKED_SQL
    + """SELECT s.snapshot, s.status, CAST(p.nth AS INTEGER) AS nth, CAST(p.days AS INTEGER) AS days,
  (SELECT count(*) FROM f WHERE f.snapshot = s.snapshot AND f.status = s.status AND f.nth = p.nth AND f.gap <= p.days) AS n
FROM (SELECT DISTINCT snapshot, status FROM sales) s, (SELECT unnest([2, 3]) AS nth) a,
 (SELECT nth, days FROM (SELECT unnest([2, 3]) AS nth), (SELECT unnest([14, 30, 60, 90]) AS days)) p WHERE a.nth = p.nth""",
)(q.repeat_within)

SHARE_SQL = ", k AS (SELECT snapshot, status, customer_id, count(*) AS n FROM sales GROUP BY ALL) "
shop_q(
    "tpl_shop_9",
    SHARE_SQL
    + """SELECT snapshot, status, CAST(m AS INTEGER) AS least,
  round(100 * (count(*) FILTER (n >= m)::DOUBLE / count(*)), 2) AS pct FROM k, (SELECT unnest([2, 3, 4]) AS m) GROUP BY ALL""",
)(q.repeat_share)

# ---------------------------------------------------------------- hr templates

hr_q("tpl_hr_1", "SELECT snapshot, state, count(*) AS n FROM st GROUP BY ALL")(q.staff_counts)

hr_q(
    "tpl_hr_2",
    """SELECT d.snapshot, s.state, d.name, count(e.id) AS n FROM departments d CROSS JOIN (SELECT unnest(['current', 'former'])
  AS state) s LEFT JOIN st e ON e.snapshot = d.snapshot AND e.dept_id = d.id AND e.state = s.state GROUP BY ALL""",
)(q.staff_by_department)

hr_q(
    "tpl_hr_3",
    """SELECT snapshot, state, round(sum(cur_amount) / count(*), 2) AS mean, max(cur_amount) AS highest,
  min(cur_amount) AS lowest FROM pay GROUP BY ALL""",
    with_pay=True,
)(q.salary_levels)

DEPT_PAY_SQL = """, dp AS (SELECT pay.snapshot, state, d.name, sum(cur_amount) / count(*) AS m FROM pay JOIN departments d
  ON d.snapshot = pay.snapshot AND d.id = dept_id GROUP BY ALL)
SELECT snapshot, state, name FROM dp QUALIFY row_number() OVER (PARTITION BY snapshot, state ORDER BY m DESC, name) = 1"""
hr_q("tpl_hr_4", DEPT_PAY_SQL, with_pay=True)(q.best_paid_department)

SCORES_SQL = """, sc AS (SELECT r.snapshot, review_year, d.name, sum(score)::DOUBLE / count(*) AS mean, count(*) AS n FROM reviews r
  JOIN employees e ON e.snapshot = r.snapshot AND e.id = employee_id JOIN departments d ON d.snapshot = r.snapshot
  AND d.id = dept_id GROUP BY ALL) """
hr_q(
    "tpl_hr_5",
    SCORES_SQL
    + """SELECT * FROM (SELECT *, unnest([2, 3, 5]) AS floor FROM sc WHERE review_year BETWEEN 2020 AND 2023)
WHERE n >= floor""",
)(q.review_scores)

MANAGERS_SQL = """, mg AS (SELECT m.snapshot, m.id, m.name, count(*) AS n FROM employees e JOIN employees m ON m.snapshot = e.snapshot
  AND m.id = e.manager_id WHERE e.left_date IS NULL AND m.left_date IS NULL GROUP BY ALL)
SELECT snapshot, CAST(row_number() OVER (PARTITION BY snapshot ORDER BY n DESC, id) AS INTEGER) AS place, name, n FROM mg
QUALIFY place <= """
hr_q("tpl_hr_6", MANAGERS_SQL + "5")(q.top_managers)

hr_q(
    "tpl_hr_7",
    """SELECT snapshot, state, id, cur_amount - first_amount AS increase FROM pay
QUALIFY row_number() OVER (PARTITION BY snapshot, state ORDER BY cur_amount - first_amount DESC, id) = 1""",
    with_pay=True,
)(q.largest_raise)

TREE_SQL = """, tr AS (SELECT d.snapshot, d.id, d.name AS top FROM departments d JOIN departments p ON p.snapshot = d.snapshot
  AND p.id = d.parent_id WHERE p.name = 'Corporate' UNION ALL SELECT d.snapshot, d.id, tr.top FROM departments d JOIN tr
  ON tr.snapshot = d.snapshot AND tr.id = d.parent_id) """
hr_q(
    "tpl_hr_8",
    TREE_SQL
    + """SELECT tr.snapshot, s.state, top AS name, count(e.id) AS headcount FROM tr CROSS JOIN (SELECT unnest(['current',
  'former']) AS state) s LEFT JOIN st e ON e.snapshot = tr.snapshot AND e.dept_id = tr.id AND e.state = s.state GROUP BY ALL""",
    recursive=True,
)(q.tree_headcount)

hr_q(
    "tpl_hr_9",
    """SELECT snapshot, cut, CAST(dd AS INTEGER) AS days, round(100 * (count(*) FILTER (left_date - hire_date <= dd)::DOUBLE
  / count(*)), 2) AS pct FROM employees, (SELECT unnest([DATE '2021-01-01', DATE '2022-01-01', DATE '2023-01-01']) AS cut),
 (SELECT unnest([180, 365, 730]) AS dd) WHERE hire_date < cut GROUP BY snapshot, cut, dd""",
)(q.early_leavers)

# ---------------------------------------------------------------- events templates

ev_q(
    "tpl_ev_1",
    """SELECT e.snapshot, kind, device, count(*) AS n FROM evs e JOIN sessions s ON s.snapshot = e.snapshot
  AND s.id = session_id GROUP BY ALL""",
)(q.kind_by_device)

PLAN_SQL = """, pv AS (SELECT u.snapshot, plan, u.id, coalesce(sum(value), 0) AS v FROM users u LEFT JOIN sessions s
  ON s.snapshot = u.snapshot AND s.user_id = u.id LEFT JOIN evs e ON e.snapshot = s.snapshot AND e.session_id = s.id
  AND kind = 'purchase' GROUP BY ALL), pt AS (SELECT snapshot, plan, round(sum(v), 2) AS total, count(*) AS users FROM pv
  GROUP BY ALL) """
ev_q("tpl_ev_2", PLAN_SQL + "SELECT * FROM pt")(q.purchases_by_plan)

MINUTES = """round(sum(epoch_us(ended_at) - epoch_us(started_at))::DOUBLE / count(*) / 60000000, 2) AS minutes
  FROM sessions WHERE ended_at IS NOT NULL GROUP BY ALL"""
ev_q("tpl_ev_3", f"SELECT snapshot, device, {MINUTES}")(lambda db: q.mean_minutes(q.session_minutes(db), "device"))

SILENT = """count(*) AS n FROM users u WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.snapshot = u.snapshot
  AND s.user_id = u.id) GROUP BY ALL"""
ev_q("tpl_ev_4", f"SELECT snapshot, plan, {SILENT}")(q.silent_users)

FIRST_SQL = """, fs AS (SELECT snapshot, user_id, id, device FROM sessions
  QUALIFY row_number() OVER (PARTITION BY snapshot, user_id ORDER BY started_at, id) = 1) """
ev_q(
    "tpl_ev_5",
    FIRST_SQL + """SELECT f.snapshot, plan, device, count(*) AS n FROM fs f JOIN users u ON u.snapshot = f.snapshot
  AND u.id = user_id GROUP BY ALL""",
)(q.first_devices)

ev_q(
    "tpl_ev_6",
    """, h AS (SELECT DISTINCT snapshot, session_id, kind FROM evs)
SELECT s.snapshot, device, k.kind, round(100 * (count(h.session_id)::DOUBLE / count(*)), 2) AS pct
FROM sessions s CROSS JOIN (SELECT unnest(['view', 'click', 'purchase']) AS kind) k
LEFT JOIN h ON h.snapshot = s.snapshot AND h.session_id = s.id AND h.kind = k.kind GROUP BY ALL""",
)(lambda db: q.sessions_with_kind(db).select("snapshot", "device", "kind", q.percent(c("hits"), c("sessions")).alias("pct")))

SIZES_SQL = ", k AS (SELECT snapshot, session_id, count(*) AS n FROM evs GROUP BY ALL) "
ev_q(
    "tpl_ev_7",
    SIZES_SQL + "SELECT snapshot, median(n) AS median, max(n) AS most, sum(n)::DOUBLE / count(*) AS mean FROM k GROUP BY ALL",
)(q.session_sizes)

LATE_SQL = """, sr AS (SELECT *, row_number() OVER (PARTITION BY snapshot, user_id ORDER BY started_at, id) AS rn FROM sessions),
 fp AS (SELECT e.snapshot, kind, sr.user_id, sr.rn FROM evs e JOIN sr ON sr.snapshot = e.snapshot AND sr.id = session_id
  WHERE kind IN ('view', 'click', 'purchase')
  QUALIFY row_number() OVER (PARTITION BY e.snapshot, kind, sr.user_id ORDER BY ts) = 1) """
ev_q(
    "tpl_ev_8",
    LATE_SQL + """SELECT f.snapshot, plan, kind, count(*) AS n FROM fp f JOIN users u ON u.snapshot = f.snapshot
  AND u.id = user_id WHERE rn > 1 GROUP BY ALL""",
)(q.late_starters)


def busiest_sql(unit):
    return f"""SELECT snapshot, '{unit}' AS unit, CAST(date_trunc('{unit}', started_at) AS DATE) AS start,
  count(DISTINCT user_id) AS n FROM sessions GROUP BY 1, 3
  QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY n DESC, start) = 1"""


ev_q("tpl_ev_9", f"SELECT * FROM ({busiest_sql('week')}) UNION ALL SELECT * FROM ({busiest_sql('month')})")(q.busiest_period)

# ---------------------------------------------------------------- fixed shop tasks


def paid(df):
    return df.where(c("status") == "paid").drop("status")


shop_q("shop01", "SELECT snapshot, count(*) AS n FROM sales WHERE status = 'paid' GROUP BY ALL")(
    lambda db: paid(q.status_counts(db))
)

shop_q(
    "shop02",
    LINES_SQL + """ SELECT l.snapshot, category, round(sum(lv), 2) AS revenue FROM lines l JOIN products p
  ON p.snapshot = l.snapshot AND p.id = product_id WHERE status = 'paid' GROUP BY ALL""",
)(
    lambda db: paid(q.line_values(db))
    .where(c("grouping") == "category")
    .select("snapshot", c("label").alias("category"), c("total").alias("revenue"))
)

shop_q(
    "shop03",
    LINES_SQL + """ SELECT snapshot, customer_id AS id, round(sum(lv), 2) AS total FROM lines WHERE status = 'paid'
  GROUP BY snapshot, customer_id
  QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY round(sum(lv), 2) DESC, customer_id) = 1""",
)(lambda db: paid(q.top_customers(db, 1)).select("snapshot", c("customer_id").alias("id"), "total"))


@shop_q(
    "shop04",
    """SELECT s.snapshot, country, count(DISTINCT customer_id) AS n FROM sales s JOIN customers k ON k.snapshot = s.snapshot
  AND k.id = customer_id WHERE status = 'paid' AND country IS NOT NULL GROUP BY s.snapshot, country
  QUALIFY row_number() OVER (PARTITION BY s.snapshot ORDER BY n DESC, country) = 1""",
)
def shop04(db):
    buyers = db["orders"].where(c("status") == "paid").select("snapshot", c("customer_id").alias("id"))
    counts = (
        db["customers"].where(c("country").isNotNull())
        .join(buyers, ["snapshot", "id"], "left_semi")
        .groupBy("snapshot", "country")
        .agg(F.count("*").alias("n"))
    )
    return q.ranked(counts, ["snapshot"], 1, F.desc("n"), "country").drop("place")


shop_q(
    "shop05",
    """SELECT snapshot, count(*) AS n FROM sales s WHERE status = 'paid' AND EXISTS (SELECT 1 FROM items i
  WHERE i.snapshot = s.snapshot AND i.order_id = s.id AND quantity = 0) GROUP BY ALL""",
)(lambda db: paid(q.orders_with_quantity(db, (0,))).drop("quantity"))

shop_q(
    "shop06",
    """, f AS (SELECT snapshot, customer_id, min(order_date) AS d FROM sales WHERE status = 'paid' GROUP BY ALL)
SELECT snapshot, CAST(year(d) AS INTEGER) AS yr, count(*) AS n FROM f GROUP BY ALL""",
)(lambda db: paid(q.order_years(db)).where(c("end") == "first").drop("end"))

shop_q(
    "shop07",
    LINES_SQL + VALUES_SQL + "SELECT snapshot, country, mean AS avg_value FROM cv WHERE status = 'paid' AND n >= 10",
)(lambda db: paid(q.order_values(db, (10,))).select("snapshot", "country", c("mean").alias("avg_value")))

shop_q(
    "shop08",
    LINES_SQL + BEST_SQL + """SELECT snapshot, category, name FROM r WHERE status = 'paid'
QUALIFY row_number() OVER (PARTITION BY snapshot, category ORDER BY v DESC, id) = 1""",
)(lambda db: paid(q.best_products(db)))

shop_q(
    "shop09",
    RANKED_SQL
    + "SELECT snapshot, count(*) AS n FROM f WHERE status = 'paid' AND nth = 2 AND gap <= 30 GROUP BY ALL",
)(lambda db: paid(q.repeat_within(db, (2,), (30,))).select("snapshot", "n"))

shop_q(
    "shop10",
    SHARE_SQL
    + """SELECT snapshot, round(100 * (count(*) FILTER (n >= 2)::DOUBLE / count(*)), 2) AS pct FROM k WHERE status = 'paid'
GROUP BY ALL""",
)(lambda db: paid(q.repeat_share(db, (2,))).select("snapshot", "pct"))

# ---------------------------------------------------------------- fixed hr tasks


def current(df):
    return df.where(c("state") == "current").drop("state")


hr_q("hr01", "SELECT snapshot, count(*) AS n FROM employees WHERE left_date IS NULL GROUP BY ALL")(
    lambda db: current(q.staff_counts(db))
)
hr_q(
    "hr02",
    """SELECT d.snapshot, d.name, count(e.id) AS n FROM departments d LEFT JOIN employees e ON e.snapshot = d.snapshot
  AND e.dept_id = d.id GROUP BY ALL""",
)(lambda db: q.staff_by_department(db).groupBy("snapshot", "name").agg(F.sum("n").alias("n")))
hr_q(
    "hr03",
    "SELECT snapshot, round(sum(cur_amount) / count(*), 2) AS avg_salary FROM pay WHERE state = 'current' GROUP BY ALL",
    with_pay=True,
)(lambda db: current(q.salary_levels(db)).select("snapshot", c("mean").alias("avg_salary")))
hr_q(
    "hr04",
    DEPT_PAY_SQL.replace("SELECT snapshot, state, name FROM dp", "SELECT snapshot, name FROM dp WHERE state = 'current'"),
    with_pay=True,
)(lambda db: current(q.best_paid_department(db)))


@hr_q(
    "hr05",
    """SELECT snapshot, count(*) AS n FROM employees e WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.snapshot = e.snapshot
  AND r.employee_id = e.id) GROUP BY ALL""",
)
def hr05(db):
    reviewed = db["reviews"].select("snapshot", c("employee_id").alias("id"))
    return db["employees"].join(reviewed, ["snapshot", "id"], "left_anti").groupBy("snapshot").agg(F.count("*").alias("n"))


hr_q("hr06", MANAGERS_SQL + "3")(lambda db: q.top_managers(db, 3))
hr_q("hr07", SCORES_SQL + "SELECT snapshot, name, mean AS avg_score FROM sc WHERE review_year = 2023 AND n >= 3")(
    lambda db: q.review_scores(db, (2023,), (3,)).select("snapshot", "name", c("mean").alias("avg_score"))
)
hr_q(
    "hr08",
    """SELECT snapshot, id, cur_amount - first_amount AS increase FROM pay WHERE state = 'current'
QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY cur_amount - first_amount DESC, id) = 1""",
    with_pay=True,
)(lambda db: current(q.largest_raise(db)))
hr_q(
    "hr09",
    TREE_SQL
    + """SELECT tr.snapshot, top AS name, count(e.id) AS headcount FROM tr LEFT JOIN employees e ON e.snapshot = tr.snapshot
  AND e.dept_id = tr.id AND e.left_date IS NULL GROUP BY ALL""",
    recursive=True,
)(lambda db: current(q.tree_headcount(db)))
hr_q(
    "hr10",
    """SELECT snapshot, round(100 * (count(*) FILTER (left_date - hire_date <= 365)::DOUBLE / count(*)), 2) AS pct
FROM employees WHERE hire_date < DATE '2023-01-01' GROUP BY ALL""",
)(lambda db: q.early_leavers(db, ("2023-01-01",), (365,)).select("snapshot", "pct"))

# ---------------------------------------------------------------- fixed events tasks


@ev_q("ev01", "SELECT snapshot, device, count(*) AS n FROM sessions GROUP BY ALL")
def ev01(db):
    return db["sessions"].groupBy("snapshot", "device").agg(F.count("*").alias("n"))


@ev_q("ev02", "SELECT snapshot, round(sum(value), 2) AS total FROM evs WHERE kind = 'purchase' GROUP BY ALL")
def ev02(db):
    bought = db["events"].where(c("kind") == "purchase")
    return bought.groupBy("snapshot").agg(F.round(F.sum("value"), 2).alias("total"))


ev_q("ev03", f"SELECT snapshot, {MINUTES}")(lambda db: q.mean_minutes(q.session_minutes(db)))


@ev_q(
    "ev04",
    PLAN_SQL + """SELECT snapshot, plan FROM pt
QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY total / users DESC, plan) = 1""",
)
def ev04(db):
    per_user = q.purchases_by_plan(db).withColumn("each", ratio("total", "users"))
    return q.ranked(per_user, ["snapshot"], 1, F.desc("each"), "plan").select("snapshot", "plan")


ev_q("ev05", f"SELECT snapshot, {SILENT}")(
    lambda db: q.silent_users(db).groupBy("snapshot").agg(F.sum("n").alias("n"))
)
ev_q("ev06", FIRST_SQL + "SELECT snapshot, device, count(*) AS n FROM fs GROUP BY ALL")(
    lambda db: q.first_sessions(db).groupBy("snapshot", "device").agg(F.count("*").alias("n"))
)
ev_q(
    "ev07",
    """, h AS (SELECT DISTINCT snapshot, session_id FROM evs WHERE kind = 'purchase')
SELECT s.snapshot, round(100 * (count(h.session_id)::DOUBLE / count(*)), 2) AS pct FROM sessions s
LEFT JOIN h ON h.snapshot = s.snapshot AND h.session_id = s.id GROUP BY ALL""",
)(
    lambda db: q.sessions_with_kind(db, ("purchase",))
    .groupBy("snapshot")
    .agg(q.percent(F.sum("hits"), F.sum("sessions")).alias("pct"))
)
ev_q("ev08", SIZES_SQL + "SELECT snapshot, median(n) AS med FROM k GROUP BY ALL")(
    lambda db: q.session_sizes(db).select("snapshot", c("median").alias("med"))
)


@ev_q("ev09", LATE_SQL + "SELECT snapshot, count(*) AS n FROM fp WHERE kind = 'purchase' AND rn > 1 GROUP BY ALL")
def ev09(db):
    return q.late_starters(db, ("purchase",)).groupBy("snapshot").agg(F.sum("n").alias("n"))


ev_q("ev10", f"SELECT snapshot, start AS wk, n FROM ({busiest_sql('week')})")(
    lambda db: q.busiest_period(db, ("week",)).select("snapshot", c("start").alias("wk"), "n")
)
