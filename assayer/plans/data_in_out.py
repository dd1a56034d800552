"""Readers, writers, generators and bounded results on views of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.draws import sql_ticket as tk
from assayer.plans.views import EPISODES_SQL, episodes
from assayer.registry import query
from assayer.session import fresh_path
from assayer.sources import files, generators, sinks

c = F.col

# ---------------------------------------------------------------- readers


@query(
    "src_episode_jsonl",
    f"""WITH {EPISODES_SQL} SELECT arm, count(*) AS n, count(*) FILTER (passed) AS passes, count(via) AS with_via,
  CAST(sum(seed) AS BIGINT) AS seeds FROM e GROUP BY arm
UNION ALL SELECT 'broken', count(*), 0, 0, 0 FROM e WHERE episode % 97 = 0""",
)
def src_episode_jsonl(t):
    path = fresh_path(t.spark, "episodes")
    schema = "arm STRING, task BIGINT, seed INT, passed BOOLEAN, via STRING"
    rows = episodes(t).select("episode", F.to_json(F.struct("arm", "task", "seed", "passed", "via")).alias("line"))
    # every 97th episode leaves a cut and a blank line behind
    cut = F.when(c("episode") % 97 == 0, F.array("line", F.substring("line", 1, 9), F.lit(""))).otherwise(F.array("line"))
    lines = rows.select(F.explode(cut).alias("value"), c("episode"))
    for half in (0, 1):
        lines.where(c("episode") % 2 == half).select("value").write.text(f"{path}/{half}")
    read = files.read_episodes(t.spark, [f"{path}/0", f"{path}/1"], schema)
    arm = F.when(c("_corrupt_record").isNotNull(), "broken").otherwise(c("arm"))
    return read.groupBy(arm.alias("arm")).agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(c("passed"), F.lit(False))).alias("passes"),
        F.count("via").alias("with_via"),
        F.coalesce(F.sum("seed"), F.lit(0)).alias("seeds"),
    )


@query(
    "src_task_json",
    """SELECT 'task' || c_custkey AS id, 'nation' || c_nationkey AS schema, CAST(1 + c_custkey % 4 AS INTEGER) AS hops,
  len([c_name, c_mktsegment]) AS golds, c_custkey % 2 = 0 AS ignore_order FROM customer""",
)
def src_task_json(t):
    path = fresh_path(t.spark, "tasks")
    task = F.struct(
        F.concat(F.lit("task"), c("c_custkey").cast("string")).alias("id"),
        F.concat(F.lit("nation"), c("c_nationkey").cast("string")).alias("schema"),
        (1 + c("c_custkey") % 4).cast("int").alias("hops"),
        F.array("c_name", "c_mktsegment").alias("gold"),
        (c("c_custkey") % 2 == 0).alias("ignore_order"),
    )
    # 200 consecutive tasks make one array, so a file has a bounded size
    arrays = t.customer.groupBy(F.floor(c("c_custkey") / 200).alias("part")).agg(
        F.to_json(F.collect_list(task)).alias("value")
    )
    arrays.repartition("part").write.partitionBy("part").text(path)
    return files.read_tasks(t.spark, path).select(
        "id", "schema", "hops", F.size("gold").cast("bigint").alias("golds"), "ignore_order"
    )


@query(
    "src_gold_csv",
    """
WITH n AS (SELECT 'q' || n_nationkey AS task, n_nationkey,
   n_nationkey % 3 = 0 AS two FROM nation),
 r AS (SELECT task, two, c_custkey, c_mktsegment, row_number() OVER (PARTITION BY task ORDER BY c_custkey) - 1 AS row_ix
  FROM customer JOIN n ON n_nationkey = c_nationkey)
SELECT task, 0 AS gold_ix, row_ix, 0 AS col_ix, c_custkey::VARCHAR AS val FROM r
UNION ALL SELECT task, 0, row_ix, 1, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END FROM r
UNION ALL SELECT task, 1, row_ix, 0, c_mktsegment FROM r WHERE two""",
)
def src_gold_csv(t):
    path = fresh_path(t.spark, "gold")
    task = F.concat(F.lit("q"), c("c_nationkey").cast("string"))
    segment = F.when(c("c_custkey") % 5 == 0, "").otherwise(c("c_mktsegment"))

    def write(rows):
        rows.repartition("file").sortWithinPartitions("file", "c_custkey").write.mode("append").partitionBy(
            "file"
        ).option("header", True).option("emptyValue", "").csv(path)

    # one file per gold, as golds are stored
    write(t.customer.select(task.alias("file"), "c_custkey", segment.alias("segment")))
    second = t.customer.where(c("c_nationkey") % 3 == 0)
    ordered = second.select(F.concat(task, F.lit("_b")).alias("file"), "c_mktsegment", "c_custkey")
    ordered.repartition("file").sortWithinPartitions("file", "c_custkey").drop("c_custkey").write.mode(
        "append"
    ).partitionBy("file").option("header", True).csv(path)
    tasks = t.nation.select(F.concat(F.lit("q"), c("n_nationkey").cast("string")).alias("task"))
    cells, _, _ = files.read_gold_csv(t.spark, path, tasks, name=r"/file=([^/]+)/")
    return cells.select("task", "gold_ix", "row_ix", "col_ix", "val")


ITEMS_SQL = """
items AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'bq' ELSE 'local' END || c_custkey AS instance_id,
  'db' || c_nationkey AS db, 'Total of ' || c_name || '?' AS question,
  CASE WHEN c_custkey % 2 = 0 THEN 'notes' || c_nationkey END AS external_knowledge, c_custkey FROM customer)"""


def items(t):
    key = c("c_custkey")
    return t.customer.select(
        F.concat(F.when(key % 3 == 0, "bq").otherwise("local"), key.cast("string")).alias("instance_id"),
        F.concat(F.lit("db"), c("c_nationkey").cast("string")).alias("db"),
        F.concat(F.lit("Total of "), c("c_name"), F.lit("?")).alias("question"),
        F.when(key % 2 == 0, F.concat(F.lit("notes"), c("c_nationkey").cast("string"))).alias("external_knowledge"),
    )


@query(
    "src_benchmark_items",
    f"""WITH {ITEMS_SQL} SELECT instance_id, db, question, c_custkey % 5 = 0 AS ignore_order,
  CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END AS n_lists FROM items WHERE instance_id LIKE 'local%'""",
)
def src_benchmark_items(t):
    path = fresh_path(t.spark, "items")
    items(t).write.json(f"{path}/items")
    options = t.customer.where(c("c_custkey") % 5 == 0).select(
        F.concat(F.lit("local"), c("c_custkey").cast("string")).alias("instance_id"),
        F.expr("array(array(0), array(0, 1))").alias("condition_cols"),
        F.lit(True).alias("ignore_order"),
    )
    options.write.json(f"{path}/options")
    read = files.benchmark_items(
        t.spark.read.schema(files.ITEM).json(f"{path}/items"), t.spark.read.schema(files.EVAL).json(f"{path}/options")
    )
    return read.select("instance_id", "db", "question", "ignore_order", F.size("condition_cols").alias("n_lists"))


@query(
    "src_docs_attach",
    f"""WITH {ITEMS_SQL}, docs AS (SELECT 'notes' || n_nationkey AS name, 'About ' || n_name || chr(10) || 'in region '
   || n_regionkey AS document FROM nation WHERE n_nationkey % 4 <> 1)
SELECT instance_id, question || CASE WHEN document IS NULL THEN '' ELSE chr(10) || chr(10) || 'Reference document (' || name
  || '):' || chr(10) || document || chr(10) END AS q FROM items LEFT JOIN docs ON name = external_knowledge""",
)
def src_docs_attach(t):
    path = fresh_path(t.spark, "documents")
    text = F.concat(F.lit("About "), c("n_name"), F.lit("\nin region "), c("n_regionkey").cast("string"))
    docs = t.nation.where(c("n_nationkey") % 4 != 1).select(
        F.concat(F.lit("notes"), c("n_nationkey").cast("string")).alias("name"), text.alias("value")
    )
    docs.repartition("name").write.partitionBy("name").text(path)
    documents = files.read_documents(t.spark, path, name=r"/name=([^/]+)/")
    return files.attach_documents(items(t), documents).select("instance_id", "q")


EVIDENCE_SQL = """
ev AS (SELECT o_orderkey AS question_id, 'db' || (o_custkey % 40) AS db_id, 'Question ' || o_orderkey AS question,
  CASE WHEN o_orderkey % 2 = 0 THEN 'hint ' || o_orderpriority ELSE '' END AS evidence,
  ['simple', 'moderate', 'challenging', 'unknown'][1 + o_orderkey % 4] AS difficulty,
  CASE WHEN o_orderkey % 50 = 7 THEN 'gold failed' END AS gold_error FROM orders),
ct AS (SELECT 'db' || n_nationkey AS db_id FROM nation),
j AS (SELECT ev.*, ct.db_id IS NULL AS lost FROM ev LEFT JOIN ct USING (db_id))"""


def evidence(t):
    key = c("o_orderkey")
    level = F.element_at(
        F.array(*[F.lit(x) for x in ("simple", "moderate", "challenging", "unknown")]), (key % 4).cast("int") + 1
    )
    rows = t.orders.select(
        key.alias("question_id"),
        F.concat(F.lit("db"), (c("o_custkey") % 40).cast("string")).alias("db_id"),
        F.concat(F.lit("Question "), key.cast("string")).alias("question"),
        F.when(key % 2 == 0, F.concat(F.lit("hint "), c("o_orderpriority"))).otherwise("").alias("evidence"),
        level.alias("difficulty"),
        F.when(key % 50 == 7, "gold failed").alias("gold_error"),
    )
    catalog = t.nation.select(F.concat(F.lit("db"), c("n_nationkey").cast("string")).alias("db_id"))
    return files.evidence_items(rows, catalog)


@query(
    "src_evidence_items",
    f"""WITH {EVIDENCE_SQL} SELECT question_id, db_id, CASE difficulty WHEN 'simple' THEN 1 WHEN 'moderate' THEN 2
  WHEN 'challenging' THEN 3 ELSE 0 END AS hops, question || CASE WHEN evidence <> '' THEN chr(10) || chr(10) || 'Evidence: '
  || evidence ELSE '' END AS q FROM j WHERE NOT lost AND gold_error IS NULL""",
)
def src_evidence_items(t):
    return evidence(t)[0].select("question_id", "db_id", "hops", "q")


@query(
    "src_evidence_rejected",
    f"""WITH {EVIDENCE_SQL} SELECT CASE WHEN lost THEN 'no database' ELSE gold_error END AS reason, count(*) AS n FROM j
WHERE lost OR gold_error IS NOT NULL GROUP BY 1""",
)
def src_evidence_rejected(t):
    return evidence(t)[1].groupBy("reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- generators: one database per supplier key


def spot(low, high, *keys):
    return f"({low} + {tk(*keys)} % {high - low + 1})"


GEN_SHOP_SQL = f"""
s AS (SELECT s_suppkey AS s FROM supplier),
cu AS (SELECT s, i, CASE {tk("'country'", "s", "i")} % 6 WHEN 0 THEN 'IN' WHEN 1 THEN 'US' WHEN 2 THEN 'DE' WHEN 3 THEN 'BR'
  WHEN 4 THEN 'JP' END AS country, ['Asha', 'Ben', 'Chen', 'Dev', 'Eva', 'Fatima', 'Gus'][1 + {tk("'name'", "s", "i")} % 7]
  || CASE WHEN {tk("'initial?'", "s", "i")} % 2 = 0 THEN ' ' || ['K', 'L', 'M'][1 + {tk("'initial'", "s", "i")} % 3] ELSE '' END
  AS name, {spot(0, 400, "'signup'", "s", "i")} AS signup
  FROM s, range(1, 61) r(i) WHERE i <= {spot(40, 60, "'customers'", "s")}),
pr AS (SELECT s, i, ['books', 'toys', 'kitchen', 'garden'][1 + {tk("'category'", "s", "i")} % 4] AS cat0,
  {tk("'empty category'", "s")} % 2 = 0 AS no_garden, 200 + {tk("'price'", "s", "i")} % 11801 AS cents
  FROM s, range(1, 21) r(i) WHERE i <= {spot(12, 20, "'products'", "s")}),
od AS (SELECT s, i, 1 + {tk("'buyer'", "s", "i")} % {spot(40, 60, "'customers'", "s")} AS buyer,
  {tk("'status'", "s", "i")} % 10 AS st, {spot(0, 500, "'ordered'", "s", "i")} AS d
  FROM s, range(1, 261) r(i) WHERE i <= {spot(150, 260, "'orders'", "s")}),
it0 AS (SELECT s, i AS o, l FROM od, range(1, 5) r(l) WHERE l <= {spot(1, 4, "'lines'", "s", "i")}),
it AS (SELECT *, 1 + {tk("'item'", "s", "o", "l")} % {spot(12, 20, "'products'", "s")} AS p,
  [100, 100, 90, 110][1 + {tk("'sale'", "s", "o", "l")} % 4] AS pct,
  CASE WHEN {tk("'odd?'", "s", "o", "l")} % 100 < 5 THEN [0, 1, 1, 2, 3, 5][1 + {tk("'odd quantity'", "s", "o", "l")} % 6]
   ELSE {spot(1, 5, "'quantity'", "s", "o", "l")} END AS q FROM it0)
"""


@query(
    "gen_shop",
    f"""WITH {GEN_SHOP_SQL},
a AS (SELECT s, count(*) AS customers, count(*) - count(country) AS no_country, count(DISTINCT name) AS names,
  CAST(sum(signup) AS BIGINT) AS signup FROM cu GROUP BY s),
b AS (SELECT s, count(*) AS products, count(*) FILTER (cat0 = 'garden' AND NOT no_garden) AS garden,
  sum(cents) / 100.0 AS list_price FROM pr GROUP BY s),
c AS (SELECT s, count(*) AS orders, count(*) FILTER (st < 8) AS paid, count(DISTINCT buyer) AS buyers,
  CAST(sum(d) AS BIGINT) AS days FROM od GROUP BY s),
d AS (SELECT s, count(*) AS lines, CAST(sum(q) AS BIGINT) AS quantity, count(*) FILTER (q = 0) AS zero,
  sum(((200 + {tk("'price'", "s", "p")} % 11801) * pct + 50) // 100 * q) / 100.0 AS value FROM it GROUP BY s)
SELECT s AS snapshot, customers, no_country, names, signup, products, garden, CAST(list_price AS DOUBLE) AS list_price, orders,
  paid, buyers, days, lines, quantity, zero, CAST(value AS DOUBLE) AS value FROM a JOIN b USING (s) JOIN c USING (s) JOIN d USING (s)""",
)
def gen_shop(t):
    db = generators.generate(t.supplier.select(c("s_suppkey").alias("snapshot")), "shop")
    start = F.lit("2024-01-01").cast("date")
    customers = db["customers"].groupBy("snapshot").agg(
        F.count("*").alias("customers"),
        F.count_if(c("country").isNull()).alias("no_country"),
        F.count_distinct("name").alias("names"),
        F.sum(F.date_diff("signup_date", start).cast("bigint")).alias("signup"),
    )
    products = db["products"].groupBy("snapshot").agg(
        F.count("*").alias("products"),
        F.count_if(c("category") == "garden").alias("garden"),
        F.sum("unit_price").cast("double").alias("list_price"),
    )
    orders = db["orders"].groupBy("snapshot").agg(
        F.count("*").alias("orders"),
        F.count_if(c("status") == "paid").alias("paid"),
        F.count_distinct("customer_id").alias("buyers"),
        F.sum(F.date_diff("order_date", start).cast("bigint")).alias("days"),
    )
    items_ = db["order_items"].groupBy("snapshot").agg(
        F.count("*").alias("lines"),
        F.sum("quantity").alias("quantity"),
        F.count_if(c("quantity") == 0).alias("zero"),
        F.sum(c("unit_price") * c("quantity")).cast("double").alias("value"),
    )
    return customers.join(products, "snapshot").join(orders, "snapshot").join(items_, "snapshot")


GEN_HR_SQL = f"""
s AS (SELECT s_suppkey AS s FROM supplier),
e0 AS (SELECT s, i, {spot(2, 6, "'department'", "s", "i")} AS dept, CASE WHEN i > 1 AND {tk("'led'", "s", "i")} % 10 > 0
   THEN 1 + {tk("'manager'", "s", "i")} % (i - 1) END AS boss, {spot(0, 2200, "'hired'", "s", "i")} AS h,
   CASE WHEN {tk("'left'", "s", "i")} % 5 = 0 THEN {spot(30, 1500, "'stayed'", "s", "i")} END AS stay
  FROM s, range(1, 71) r(i) WHERE i <= {spot(45, 70, "'staff'", "s")}),
em AS (SELECT *, DATE '2018-01-01' + CAST(h AS INTEGER) AS hire, DATE '2018-01-01' + CAST(h + stay AS INTEGER) AS gone FROM e0),
p0 AS (SELECT *, {spot(300, 900, "'salary'", "s", "i")} AS a0, {spot(0, 3, "'raises'", "s", "i")} AS raises FROM em),
p1 AS (SELECT *, (a0 * (1000 + {tk("'raise'", "s", "i", "1")} % 151) + 500) // 1000 AS a1 FROM p0),
p2 AS (SELECT *, (a1 * (1000 + {tk("'raise'", "s", "i", "2")} % 151) + 500) // 1000 AS a2 FROM p1),
p3 AS (SELECT *, (a2 * (1000 + {tk("'raise'", "s", "i", "3")} % 151) + 500) // 1000 AS a3 FROM p2),
sl AS (SELECT s, i, k, [a0, a1, a2, a3][k + 1] AS amount FROM p3, range(4) r(k) WHERE k <= raises
  AND (k = 0 OR stay IS NULL OR 365 * k <= stay)),
rv AS (SELECT s, i, y, {spot(1, 5, "'score'", "s", "i", "y")} AS score FROM em, range(2019, 2025) r(y)
  WHERE {tk("'reviewed'", "s", "i", "y")} % 10 < 7 AND year(hire) <= y AND (gone IS NULL OR year(gone) >= y))
"""


@query(
    "gen_hr",
    f"""WITH {GEN_HR_SQL},
a AS (SELECT s, count(*) AS staff, count(boss) AS led, CAST(sum(boss) AS BIGINT) AS bosses, count(stay) AS former,
  CAST(sum(h) AS BIGINT) AS hired, CAST(sum(dept) AS BIGINT) AS depts FROM em GROUP BY s),
b AS (SELECT s, count(*) AS salaries, CAST(sum(amount) * 100 AS DOUBLE) AS paid FROM sl GROUP BY s),
c AS (SELECT s, count(*) AS reviews, CAST(sum(score) AS BIGINT) AS scores FROM rv GROUP BY s)
SELECT s AS snapshot, staff, led, bosses, former, hired, depts, salaries, paid, reviews, scores,
  6 + CASE WHEN {tk("'empty department'", "s")} % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS departments
FROM a JOIN b USING (s) JOIN c USING (s)""",
)
def gen_hr(t):
    db = generators.generate(t.supplier.select(c("s_suppkey").alias("snapshot")), "hr")
    staff = db["employees"].groupBy("snapshot").agg(
        F.count("*").alias("staff"),
        F.count("manager_id").alias("led"),
        F.sum("manager_id").alias("bosses"),
        F.count("left_date").alias("former"),
        F.sum(F.date_diff("hire_date", F.lit("2018-01-01").cast("date")).cast("bigint")).alias("hired"),
        F.sum("dept_id").alias("depts"),
    )
    salaries = db["salaries"].groupBy("snapshot").agg(
        F.count("*").alias("salaries"), F.sum("amount").cast("double").alias("paid")
    )
    reviews = db["reviews"].groupBy("snapshot").agg(F.count("*").alias("reviews"), F.sum("score").alias("scores"))
    departments = db["departments"].groupBy("snapshot").agg(F.count("*").alias("departments"))
    return staff.join(salaries, "snapshot").join(reviews, "snapshot").join(departments, "snapshot")


GEN_EVENTS_SQL = f"""
s AS (SELECT s_suppkey AS s FROM supplier),
us AS (SELECT s, i, {tk("'plan'", "s", "i")} % 10 AS plan, {spot(0, 1440, "'created'", "s", "i")} AS created
  FROM s, range(1, 51) r(i) WHERE i <= {spot(30, 50, "'users'", "s")}),
se AS (SELECT s, i, k, i * 10 + k AS id, 3600 * (created + {spot(1, 2160, "'started'", "s", "i", "k")}) AS t0,
  CASE WHEN {tk("'closed'", "s", "i", "k")} % 10 < 9 THEN {spot(1, 180, "'length'", "s", "i", "k")} END AS mins,
  {tk("'device'", "s", "i", "k")} % 3 AS device FROM us, range(1, 9) r(k) WHERE k <= {spot(0, 8, "'sessions'", "s", "i")}),
e0 AS (SELECT s, id, n, t0, {spot(5, 600, "'gap'", "s", "id", "n")} AS gap, {tk("'kind'", "s", "id", "n")} % 11 AS kind,
  100 + {tk("'value'", "s", "id", "n")} % 19901 AS cents FROM se, range(1, 13) r(n) WHERE n <= {spot(1, 12, "'events'", "s", "id")}),
e1 AS (SELECT *, t0 + sum(gap) OVER (PARTITION BY s, id ORDER BY n) AS ts FROM e0)
"""


@query(
    "gen_events",
    f"""WITH {GEN_EVENTS_SQL},
a AS (SELECT s, count(*) AS users, count(*) FILTER (plan < 6) AS free FROM us GROUP BY s),
b AS (SELECT s, count(*) AS sessions, count(mins) AS closed, CAST(sum(mins) AS BIGINT) AS minutes,
  count(*) FILTER (device = 2) AS web FROM se GROUP BY s),
c AS (SELECT s, count(*) AS events, count(*) FILTER (kind = 10) AS purchases,
  round(sum(cents / 100.0::DOUBLE) FILTER (kind = 10), 2) AS value, CAST(sum(ts) AS BIGINT) AS seconds FROM e1 GROUP BY s)
SELECT s AS snapshot, * EXCLUDE (s) FROM a JOIN b USING (s) JOIN c USING (s)""",
)
def gen_events(t):
    db = generators.generate(t.supplier.select(c("s_suppkey").alias("snapshot")), "events")
    zero = F.lit("2025-03-01 00:00:00").cast("timestamp_ntz")
    users = db["users"].groupBy("snapshot").agg(
        F.count("*").alias("users"), F.count_if(c("plan") == "free").alias("free")
    )
    sessions = db["sessions"].groupBy("snapshot").agg(
        F.count("*").alias("sessions"),
        F.count("ended_at").alias("closed"),
        F.sum(F.timestamp_diff("MINUTE", c("started_at"), c("ended_at"))).alias("minutes"),
        F.count_if(c("device") == "web").alias("web"),
    )
    rows = db["events"].groupBy("snapshot").agg(
        F.count("*").alias("events"),
        F.count_if(c("kind") == "purchase").alias("purchases"),
        F.round(F.sum("value"), 2).alias("value"),
        F.sum(F.timestamp_diff("SECOND", zero, c("ts"))).alias("seconds"),
    )
    return users.join(sessions, "snapshot").join(rows, "snapshot")


# ---------------------------------------------------------------- sinks and bounds


@query(
    "sink_table_export",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  o_orderpriority FROM orders""",
)
def sink_table_export(t):
    path = fresh_path(t.spark, "export")
    sinks.export_table(t.orders, path)
    return t.spark.read.parquet(path)


@query(
    "sink_append_log",
    f"""WITH {EPISODES_SQL} SELECT arm, month_no, count(*) AS n, count(*) FILTER (passed) AS passes FROM e GROUP BY ALL""",
)
def sink_append_log(t):
    path = fresh_path(t.spark, "log")
    rows = episodes(t).select("arm", "month_no", "task", "seed", "passed")
    sinks.append_log(rows.where(c("seed") <= 4), path)
    sinks.append_log(rows.where(c("seed") > 4), path)
    log = t.spark.read.schema("arm STRING, month_no INT, task BIGINT, seed INT, passed BOOLEAN").json(path)
    return log.groupBy("arm", "month_no").agg(F.count("*").alias("n"), F.count_if("passed").alias("passes"))


@query(
    "resume_todo",
    f"""WITH {EPISODES_SQL} SELECT c_custkey AS task, CAST(i AS INTEGER) AS seed FROM customer, range(1, 13) r(i)
WHERE NOT EXISTS (SELECT 1 FROM e WHERE task = c_custkey AND seed = i)""",
)
def resume_todo(t):
    return sinks.todo(t.customer.select(c("c_custkey").alias("task")), list(range(1, 13)), episodes(t))


@query(
    "task_filter_sample",
    f"""SELECT c_custkey AS task, c_name FROM customer WHERE c_nationkey IN (1, 5, 9, 12, 20)
ORDER BY {tk("0", "c_custkey")}, c_custkey LIMIT 50""",
)
def task_filter_sample(t):
    tasks = t.customer.select(c("c_custkey").alias("task"), "c_name")
    listed = t.customer.where(c("c_nationkey").isin(1, 5, 9, 12, 20)).select(c("c_custkey").alias("task"))
    return sinks.sample_tasks(tasks, 50, 0, listed)


@query(
    "latest_row_per_step",
    """SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_row_per_step(t):
    rows = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    return sinks.latest_per_step(rows, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query(
    "bounded_result",
    """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
  count(*) OVER (PARTITION BY o_custkey) AS k FROM orders)
SELECT 'cut' AS rule, o_custkey, o_orderkey, o_totalprice, k > 12 AS overflow FROM n WHERE rn <= 12
UNION ALL SELECT 'error', o_custkey, CASE WHEN k <= 12 THEN o_orderkey END, CASE WHEN k <= 12 THEN o_totalprice END, k > 12
FROM n WHERE k <= 12 OR rn = 1""",
)
def bounded_result(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")

    def rule(name, cut):
        kept = sinks.bounded(rows, ["o_custkey"], ["o_orderkey"], 12, cut)
        return kept.select(F.lit(name).alias("rule"), "o_custkey", "o_orderkey", "o_totalprice", "overflow")

    return rule("cut", True).unionByName(rule("error", False))
