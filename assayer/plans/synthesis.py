"""Templated tasks over the orders, admission on four snapshots, selection by difficulty, text overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.draws import sql_ticket as tk
from assayer.operators import overlap
from assayer.operators import selection as sel
from assayer.operators import synthesis as syn
from assayer.registry import query
from assayer.session import spread

c = F.col

TEMPLATES = [
    ("priority", 1, "Count the orders whose priority is '{priority}'.",
     "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '{priority}'"),
    ("placed", 1, "Count the orders of customer {customer}.",
     "SELECT count(*) AS n FROM orders WHERE o_custkey = {customer}"),
    ("placed again", 1, "How many orders did customer {customer} place?",
     "select  COUNT(*) as N from orders where o_custkey = {customer};"),
    ("largest", 2, "Name the largest order of customer {customer} and its price; ties go to the lower key.",
     "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = {customer} ORDER BY o_totalprice DESC, o_orderkey LIMIT 1"),
    ("with quantity", 2, "Count the orders of customer {customer} that hold a line of quantity {quantity}.",
     "SELECT count(*) AS n FROM orders o WHERE o.o_custkey = {customer} AND EXISTS "
     "(SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity = {quantity})"),
    ("by status", 3, "For customer {customer}, give the mean order price per status with at least {floor} orders.",
     "SELECT o_orderstatus, sum(o_totalprice) / count(*) AS v FROM orders WHERE o_custkey = {customer} "
     "GROUP BY o_orderstatus HAVING count(*) >= {floor}"),
]


def templates(t):
    return t.spark.createDataFrame(TEMPLATES, "template STRING, hops INT, question STRING, gold STRING")


def grid(t):
    """Priorities as found in the orders; customers as found, with two quantities or two floors."""
    none = F.lit(None).cast("bigint")
    empty = F.lit("")
    priorities = t.orders.select("o_orderpriority").distinct().select(
        F.lit("priority").alias("template"), none.alias("customer"), c("o_orderpriority").alias("arg"),
        F.create_map(F.lit("priority"), c("o_orderpriority")).alias("params"),
    )
    name, key = F.lit("customer"), c("c_custkey").cast("string")
    cases = F.array(
        *[F.struct(F.lit(n).alias("template"), empty.alias("arg"), F.create_map(name, key).alias("params"))
          for n in ("placed", "placed again", "largest")],
        *[F.struct(F.lit("with quantity").alias("template"), F.lit(q).alias("arg"),
                   F.create_map(name, key, F.lit("quantity"), F.lit(q)).alias("params")) for q in ("1", "50")],
        *[F.struct(F.lit("by status").alias("template"), F.lit(f).alias("arg"),
                   F.create_map(name, key, F.lit("floor"), F.lit(f)).alias("params")) for f in ("1", "2")],
    )
    customers = spread(t.customer.select("c_custkey")).select(c("c_custkey").alias("customer"), F.inline(cases)).select(
        "template", "customer", "arg", "params"
    )
    return syn.param_grid(templates(t), priorities.unionByName(customers)).drop("params")


def sql_text(text: str, **places: str) -> str:
    out = "'" + text.replace("'", "''") + "'"
    for name, column in places.items():
        out = out.replace("{" + name + "}", f"' || {column} || '")
    return out


def grid_sql() -> str:
    by_name = {x[0]: x for x in TEMPLATES}
    selects = []
    for name, arg, source, places in [
        ("priority", "o_orderpriority", "(SELECT DISTINCT o_orderpriority FROM orders)", {"priority": "o_orderpriority"}),
        ("placed", "''", "customer", {"customer": "c_custkey"}),
        ("placed again", "''", "customer", {"customer": "c_custkey"}),
        ("largest", "''", "customer", {"customer": "c_custkey"}),
        ("with quantity", "a", "customer, (SELECT unnest(['1', '50']) AS a)", {"customer": "c_custkey", "quantity": "a"}),
        ("by status", "a", "customer, (SELECT unnest(['1', '2']) AS a)", {"customer": "c_custkey", "floor": "a"}),
    ]:
        _, hops, question, gold = by_name[name]
        who = "NULL::BIGINT" if name == "priority" else "c_custkey"
        selects.append(
            f"SELECT '{name}' AS template, {who} AS customer, {arg} AS arg, {hops} AS hops,"
            f" {sql_text(question, **places)} AS question, {sql_text(gold, **places)} AS gold FROM {source}"
        )
    return "gr AS (" + " UNION ALL ".join(selects) + ")"


GRID_SQL = grid_sql()
NORMAL_SQL = r"lower(rtrim(trim(regexp_replace(gold, '[ \t\r\n\f]+', ' ', 'g')), ';'))"
UNIQUE_SQL = f"""{GRID_SQL}, un AS (SELECT *, md5({NORMAL_SQL}) AS text_key, count(*) OVER (PARTITION BY {NORMAL_SQL}) AS copies
  FROM gr QUALIFY row_number() OVER (PARTITION BY {NORMAL_SQL} ORDER BY {tk("7", "template", "gold")}, template, gold) = 1)"""


def unique(t):
    return syn.first_of_equal(grid(t), "gold", 7)


@query("syn_param_grid", f"WITH {GRID_SQL} SELECT template, hops, question, gold FROM gr")
def syn_param_grid(t):
    return grid(t).select("template", "hops", "question", "gold")


@query("syn_dedup_norm", f"WITH {UNIQUE_SQL} SELECT text_key, template, gold, copies FROM un")
def syn_dedup_norm(t):
    return unique(t).select("text_key", "template", "gold", "copies")


@query(
    "syn_hop_mix",
    f"""WITH {UNIQUE_SQL} SELECT hops, text_key FROM un QUALIFY row_number() OVER (PARTITION BY hops
 ORDER BY {tk("3", "text_key")}, text_key) <= CASE hops WHEN 2 THEN 200 ELSE 100 END""",
)
def syn_hop_mix(t):
    return syn.hop_mix(unique(t), [1, 2, 2, 3], 400, 3).select("hops", "text_key")


ANSWERS_SQL = """
od AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS snapshot, o_orderstatus, o_orderpriority, o_totalprice FROM orders),
sp AS (SELECT unnest([0, 1, 2, 3]) AS snapshot),
an AS (
 SELECT 'priority' AS template, NULL::BIGINT AS customer, o_orderpriority AS arg, snapshot, count(*)::VARCHAR AS x FROM od
  GROUP BY ALL
 UNION ALL SELECT 'placed', c_custkey, '', sp.snapshot, count(o_orderkey)::VARCHAR FROM customer CROSS JOIN sp
  LEFT JOIN od ON o_custkey = c_custkey AND od.snapshot = sp.snapshot GROUP BY ALL
 UNION ALL SELECT 'placed again', c_custkey, '', sp.snapshot, count(o_orderkey)::VARCHAR FROM customer CROSS JOIN sp
  LEFT JOIN od ON o_custkey = c_custkey AND od.snapshot = sp.snapshot GROUP BY ALL
 UNION ALL SELECT 'largest', o_custkey, '', snapshot, arg_max(o_orderkey, (o_totalprice, -o_orderkey))::VARCHAR FROM od GROUP BY ALL
 UNION ALL SELECT 'with quantity', c_custkey, a, sp.snapshot, count(z.o_orderkey)::VARCHAR FROM customer CROSS JOIN sp
  CROSS JOIN (SELECT unnest(['1', '50']) AS a) LEFT JOIN (SELECT DISTINCT od.*, l_quantity FROM od JOIN lineitem
   ON l_orderkey = o_orderkey WHERE l_quantity IN (1, 50)) z ON z.o_custkey = c_custkey AND z.snapshot = sp.snapshot
   AND z.l_quantity = a::DOUBLE GROUP BY ALL
 UNION ALL SELECT 'by status', o_custkey, a, snapshot, o_orderstatus || round(sum(o_totalprice) * 100)::BIGINT || '/' || count(*)
  FROM od, (SELECT unnest(['1', '2']) AS a) GROUP BY o_custkey, a, snapshot, o_orderstatus HAVING count(*) >= a::INT),
fp AS (SELECT template, customer, arg, snapshot, string_agg(x, '|' ORDER BY x) AS fingerprint FROM an GROUP BY ALL),
se AS (SELECT template, customer, arg, bool_or(snapshot = 0) AS visible, count(*) AS present,
  count(DISTINCT fingerprint) AS kinds FROM fp GROUP BY ALL)
"""
ADMIT_SQL = f"""{UNIQUE_SQL}, {ANSWERS_SQL}, ad AS (SELECT un.*, CASE WHEN NOT coalesce(visible, false) THEN 'empty on visible'
  WHEN coalesce(kinds, 0) + CASE WHEN coalesce(present, 0) < 4 THEN 1 ELSE 0 END = 1 THEN 'constant answer' ELSE '' END AS reason
  FROM un LEFT JOIN se ON se.template = un.template AND se.customer IS NOT DISTINCT FROM un.customer AND se.arg = un.arg)"""


def answers(t):
    """The rows of every task on every snapshot, as text. Counts have a row, 0, where nothing is found."""
    orders = t.orders.withColumn("snapshot", (c("o_orderkey") % 4).cast("int"))
    none = F.lit(None).cast("bigint")
    cols = ["template", "customer", "arg", "snapshot", "x"]
    priority = orders.groupBy("snapshot", c("o_orderpriority").alias("arg")).agg(
        F.count("*").cast("string").alias("x")
    ).select(F.lit("priority").alias("template"), none.alias("customer"), "arg", "snapshot", "x")
    everyone = t.customer.select(
        c("c_custkey").alias("customer"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("snapshot")
    )

    def counted(found, base):
        full = base.join(found, [x for x in base.columns if x in found.columns], "left")
        return full.withColumn("x", F.coalesce("n", F.lit(0)).cast("string"))

    placed = counted(
        orders.groupBy(c("o_custkey").alias("customer"), "snapshot").agg(F.count("*").alias("n")), everyone
    ).withColumn("arg", F.lit("")).withColumn("template", F.explode(F.array(F.lit("placed"), F.lit("placed again"))))
    largest = orders.groupBy(c("o_custkey").alias("customer"), "snapshot").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", -c("o_orderkey"))).cast("string").alias("x")
    ).select(F.lit("largest").alias("template"), "customer", F.lit("").alias("arg"), "snapshot", "x")
    lines = t.lineitem.where(c("l_quantity").isin(1, 50)).select(
        c("l_orderkey").alias("o_orderkey"), c("l_quantity").cast("int").cast("string").alias("arg")
    ).distinct()
    holding = lines.join(orders, "o_orderkey").groupBy(c("o_custkey").alias("customer"), "snapshot", "arg").agg(
        F.count("*").alias("n")
    )
    quantity = counted(holding, everyone.withColumn("arg", F.explode(F.array(F.lit("1"), F.lit("50"))))).withColumn(
        "template", F.lit("with quantity")
    )
    cents = F.round(F.sum("o_totalprice") * 100).cast("bigint").cast("string")
    status = (
        orders.groupBy(c("o_custkey").alias("customer"), "snapshot", "o_orderstatus")
        .agg(cents.alias("v"), F.count("*").alias("k"))
        .withColumn("floor", F.explode(F.array(F.lit(1), F.lit(2))))
        .where(c("k") >= c("floor"))
        .select(
            F.lit("by status").alias("template"), "customer", c("floor").cast("string").alias("arg"), "snapshot",
            F.concat("o_orderstatus", "v", F.lit("/"), c("k").cast("string")).alias("x"),
        )
    )
    parts = [priority, placed, largest, quantity, status]
    out = parts[0].select(*cols)
    for part in parts[1:]:
        out = out.unionByName(part.select(*cols))
    return out


def admitted(t):
    keys = ["template", "customer", "arg"]
    # tasks about no single customer share the key -1, so the joins below are plain equi-joins
    prints = syn.result_prints(answers(t).fillna(-1, ["customer"]), [*keys, "snapshot"], "x")
    return syn.admit(unique(t).fillna(-1, ["customer"]), prints, keys, 0, 4)


@query("syn_admit", f"WITH {ADMIT_SQL} SELECT text_key, reason = '' AS admitted, reason FROM ad")
def syn_admit(t):
    return admitted(t).select("text_key", "admitted", "reason")


@query(
    "syn_reject_report",
    f"""WITH {ADMIT_SQL} SELECT template, hops, reason, count(*) AS n FROM ad GROUP BY ALL
UNION ALL SELECT template, hops, 'duplicate', count(*) FROM gr WHERE gold NOT IN (SELECT gold FROM un) GROUP BY ALL""",
)
def syn_reject_report(t):
    judged = admitted(t).groupBy("template", "hops", "reason").agg(F.count("*").alias("n"))
    kept = unique(t).groupBy("template", "hops").agg(F.count("*").alias("kept"))
    drawn = grid(t).groupBy("template", "hops").agg(F.count("*").alias("drawn"))
    doubles = (
        drawn.join(kept, ["template", "hops"], "left")
        .select("template", "hops", F.lit("duplicate").alias("reason"), (c("drawn") - F.coalesce("kept", F.lit(0))).alias("n"))
        .where(c("n") > 0)
    )
    return judged.unionByName(doubles)


# ---------------------------------------------------------------- selection by difficulty, size and group

SCORE_SQL = rf"""{UNIQUE_SQL}, p AS (SELECT text_key, ' ' || upper(rtrim(trim(regexp_replace(gold, '[ \t\r\n\f]+', ' ', 'g')), ';')) || ' '
  AS s FROM un), sc AS (SELECT text_key, CAST(2 * len(regexp_extract_all(s, ' JOIN ')) + 3 * len(regexp_extract_all(s, '\( ?SELECT'))
  + (s LIKE '% GROUP BY %')::INT + 2 * (s LIKE '% HAVING %')::INT + len(regexp_extract_all(s, ' CASE '))
  + 3 * (s LIKE '% OVER (%' OR s LIKE '% OVER(%')::INT + len(regexp_extract_all(s, '[\w)]\s*[*/]\s*[\w(]'))
  + 2 * (s LIKE '% UNION %' OR s LIKE '% EXCEPT %' OR s LIKE '% INTERSECT %')::INT + (len(s) > 200)::INT
  + (len(s) > 350)::INT AS INTEGER) AS score FROM p)"""


@query("sel_difficulty_proxy", f"WITH {SCORE_SQL} SELECT text_key, score FROM sc")
def sel_difficulty_proxy(t):
    return sel.difficulty(unique(t), "gold").select("text_key", "score")


@query(
    "sel_score_histogram",
    f"WITH {SCORE_SQL} SELECT least(score, 12) AS score, count(*) AS n FROM sc GROUP BY 1",
)
def sel_score_histogram(t):
    return sel.score_histogram(sel.difficulty(unique(t), "gold"))


DOCS_SQL = """d AS (SELECT doc_id, source, n_chars // 500 AS score FROM documents),
z AS (SELECT source, sum(n_chars) / 1000.0 AS size FROM documents WHERE source <> 'src3' GROUP BY source),
k AS (SELECT d.* FROM d JOIN z USING (source) WHERE score >= 2 AND size <= (SELECT median(size) FROM z)
  AND doc_id NOT IN (SELECT doc_id FROM labels))"""


def scored_documents(t):
    return t.documents.select("doc_id", "source", F.floor(c("n_chars") / 500).alias("score"))


def document_choice(t):
    # the size of source src3 is unknown, and unknown counts as too large
    sizes = t.documents.where(c("source") != "src3").groupBy("source").agg((F.sum("n_chars") / 1000.0).alias("size"))
    cap = sizes.agg(F.median("size")).scalar()  # one row per source
    return sel.floor_exclude_size(scored_documents(t), sizes, t.labels, 2, cap, "source", "doc_id")


@query("sel_floor_exclude_size", f"WITH {DOCS_SQL} SELECT doc_id, source, score FROM k")
def sel_floor_exclude_size(t):
    return document_choice(t).select("doc_id", "source", "score")


@query(
    "sel_cap_per_group_topn",
    f"""WITH {DOCS_SQL}, r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY score DESC, {tk("5", "doc_id")}, doc_id)
  AS place FROM d) SELECT doc_id, source, score FROM r WHERE place <= 20 ORDER BY score DESC, {tk("5", "doc_id")}, doc_id
LIMIT 150""",
)
def sel_cap_per_group_topn(t):
    return sel.capped_per_group(scored_documents(t), "source", "score", "doc_id", 20, 150, 5)


# ---------------------------------------------------------------- overlap

SHINGLES = r"""list_distinct(list_transform(range(1, greatest(len(w) - 7, 0) + 1), lambda i: array_to_string(w[i:i+7], ' ')))"""


@query(
    "overlap_stratum",
    rf"""WITH dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w
  FROM documents), ds AS (SELECT doc_id, {SHINGLES} AS runs FROM dw),
 bw AS (SELECT string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark),
 bs AS (SELECT DISTINCT unnest({SHINGLES}) AS run FROM bw),
 h AS (SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(runs) AS run FROM ds) JOIN bs USING (run) GROUP BY doc_id)
SELECT doc_id, CAST(len(runs) AS BIGINT) AS shingles, coalesce(hits, 0) AS hits,
  CASE WHEN hits > 0 THEN 'seen' ELSE 'unseen' END AS stratum FROM ds LEFT JOIN h USING (doc_id)""",
)
def overlap_stratum(t):
    return overlap.shared_text(t.documents.select("doc_id", "text"), "doc_id", t.benchmark, "item_id")


@query(
    "overlap_names",
    """
WITH n AS (SELECT o_custkey, list_sort(list(DISTINCT p_brand)) AS names FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN part ON p_partkey = l_partkey GROUP BY o_custkey),
 k AS (SELECT ['Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6'] AS seen)
SELECT o_custkey, len(list_intersect(names, seen))::DOUBLE / len(list_distinct(list_concat(names, seen))) AS jaccard
FROM n, k""",
)
def overlap_names(t):
    seen = F.array(*[F.lit(f"Brand#{i}") for i in range(1, 7)])
    pairs = (
        t.lineitem
        .join(t.orders, c("l_orderkey") == c("o_orderkey"))
        .join(t.part, c("l_partkey") == c("p_partkey"))
        .select("o_custkey", "p_brand")
        .distinct()
    )
    # a set holds at most the brands there are
    names = pairs.groupBy("o_custkey").agg(F.collect_list("p_brand").alias("names"))
    return names.select("o_custkey", overlap.jaccard(c("names"), seen).alias("jaccard"))
