"""Answer tables compared with gold tables: one task per nation, one snapshot per return flag.

The gold of a nation lists its customers with their line count, revenue and segment. Nine kinds of answers
are made from it: right ones in other forms and wrong ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.numeric import total
from assayer.operators import compare as cmp
from assayer.operators import ladder as lad
from assayer.operators.ranking import number_rows
from assayer.plans.views import EPISODES_SQL, episodes
from assayer.registry import query
from assayer.session import written

c = F.col
COLUMNS = ["customer", "n_lines", "revenue", "segment"]
CATALOG = ["orders", "customer", "lineitem", "part", "supplier", "nation", "region"]

# ---------------------------------------------------------------- the tables


def gold_rows(t):
    per_customer = (
        t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
        .groupBy("o_custkey", "l_returnflag")
        .agg(F.count("*").alias("n_lines"), total("l_extendedprice").alias("revenue"))
    )
    snapshot = F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2)
    rows = per_customer.join(t.customer, c("o_custkey") == c("c_custkey")).select(
        c("c_nationkey").alias("task"), snapshot.alias("snapshot"), c("c_custkey").alias("customer"),
        "n_lines", "revenue", c("c_mktsegment").alias("segment"),
    )
    numbered = number_rows(rows, ["task", "snapshot"], ["customer"], "row_no")
    return numbered.withColumn("row_ix", c("row_no") - 1).drop("row_no")


def answers(rows):
    """Cells of the nine kinds of answers, unfolded from the gold rows in one pass."""
    sizes = rows.groupBy("task", "snapshot").agg(F.count("*").alias("size"))
    known = rows.join(sizes, ["task", "snapshot"])
    types = dict(known.dtypes)
    revenue = c("revenue")
    plain = {x: cmp.raw_cell(c(x), types[x]) for x in COLUMNS}
    place = c("row_ix")

    def form(name, cells, row_ix=place, when=None):
        made = F.struct(F.lit(name).alias("attempt"), row_ix.alias("row_ix"), F.array(*cells).alias("cells"))
        return made if when is None else F.when(when, made)

    def with_revenue(value):
        return [cmp.raw_cell(value, "double") if x == "revenue" else plain[x] for x in COLUMNS]

    same = list(plain.values())
    forms = F.array(
        form("same", same),
        form("extra column", [cmp.raw_cell(F.lit("x"), "string"), *same]),
        form("permuted", same[::-1]),
        form("reversed rows", same, c("size") - 1 - place),
        form("near", with_revenue(F.round(revenue + 0.005, 3))),
        form("far", with_revenue(F.round(revenue + 0.02, 2))),
        form("short", same, when=place < c("size") - 1),
        form("missing value", with_revenue(F.when(c("customer") % 7 != 0, revenue))),
        form("doubled", same),
        form("doubled", same, c("size"), place == 0),
    )
    unfolded = known.select("task", "snapshot", F.inline(F.array_compact(forms)))
    long = unfolded.select("task", "attempt", "snapshot", "row_ix", F.posexplode("cells").alias("col_ix", "x"))
    return long.select("task", "attempt", "snapshot", "row_ix", "col_ix", *cmp.cell_columns("x"))


def golds(rows):
    """Two golds per task; the second has its revenue 0.02 higher."""
    keys = ["task", "snapshot", "gold_ix"]
    first = cmp.to_cells(rows.withColumn("gold_ix", F.lit(0)), keys, COLUMNS)
    higher = rows.withColumn("revenue", F.round(c("revenue") + 0.02, 2)).withColumn("gold_ix", F.lit(1))
    return first.unionByName(cmp.to_cells(higher, keys, COLUMNS))


def tasks_of(rows, condition_cols="CAST(array() AS ARRAY<ARRAY<INT>>)"):
    """Even tasks ignore the order of rows."""
    return rows.select("task").distinct().select(
        "task", (c("task") % 2 == 0).alias("ignore_order"), F.expr(condition_cols).alias("condition_cols")
    )


def setup(t, n_golds=1, condition_cols="CAST(array() AS ARRAY<ARRAY<INT>>)", gaps=False):
    """Cells, shapes and tasks. With ``gaps`` every fifth line count is missing in the golds, and 0 or missing in the answers."""
    # results under comparison are stored tables of cells, some forty to a row
    rows = written(gold_rows(t))
    spread = rows.repartition(t.spark.sparkContext.defaultParallelism)
    known = F.when((c("row_ix") % 5 != 0) | F.lit(not gaps), c("n_lines"))
    zero = F.when((c("row_ix") % 2 == 0) & F.lit(gaps), F.lit(0).cast("bigint"))
    gold = written(golds(spread.withColumn("n_lines", known)).where(c("gold_ix") < n_golds))
    pred = written(answers(spread.withColumn("n_lines", F.coalesce(known, zero))))
    return gold, pred, cmp.shapes_of(gold, cmp.GOLD), cmp.shapes_of(pred, cmp.PRED), tasks_of(rows, condition_cols)


ROWS_SQL = """
rows0 AS (SELECT c_nationkey AS task, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER)
   AS snapshot, c_custkey AS customer, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS revenue, c_mktsegment AS segment
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
rw AS (SELECT *, row_number() OVER (PARTITION BY task, snapshot ORDER BY customer) - 1 AS row_ix,
  count(*) OVER (PARTITION BY task, snapshot) AS size FROM rows0),
wide AS (
  SELECT task, 'same' AS attempt, snapshot, row_ix, [customer::DOUBLE::VARCHAR, n_lines::DOUBLE::VARCHAR, revenue::VARCHAR, segment] AS v FROM rw
  UNION ALL SELECT task, 'extra column', snapshot, row_ix, ['x', customer::DOUBLE::VARCHAR, n_lines::DOUBLE::VARCHAR, revenue::VARCHAR, segment] FROM rw
  UNION ALL SELECT task, 'permuted', snapshot, row_ix, [segment, revenue::VARCHAR, n_lines::DOUBLE::VARCHAR, customer::DOUBLE::VARCHAR] FROM rw
  UNION ALL SELECT task, 'reversed rows', snapshot, size - 1 - row_ix, [customer::DOUBLE::VARCHAR, n_lines::DOUBLE::VARCHAR, revenue::VARCHAR, segment] FROM rw
  UNION ALL SELECT task, 'near', snapshot, row_ix, [customer::DOUBLE::VARCHAR, n_lines::DOUBLE::VARCHAR, round(revenue + 0.005, 3)::VARCHAR, segment] FROM rw
  UNION ALL SELECT task, 'far', snapshot, row_ix, [customer::DOUBLE::VARCHAR, n_lines::DOUBLE::VARCHAR, round(revenue + 0.02, 2)::VARCHAR, segment] FROM rw
  UNION ALL SELECT task, 'short', snapshot, row_ix, [customer::DOUBLE::VARCHAR, n_lines::DOUBLE::VARCHAR, revenue::VARCHAR, segment] FROM rw WHERE row_ix < size - 1
  UNION ALL SELECT task, 'missing value', snapshot, row_ix, [customer::DOUBLE::VARCHAR, n_lines::DOUBLE::VARCHAR,
    CASE WHEN customer % 7 <> 0 THEN revenue::VARCHAR END, segment] FROM rw
  UNION ALL SELECT task, 'doubled', snapshot, row_ix, [customer::DOUBLE::VARCHAR, n_lines::DOUBLE::VARCHAR, revenue::VARCHAR, segment] FROM rw
  UNION ALL SELECT task, 'doubled', snapshot, size, [customer::DOUBLE::VARCHAR, n_lines::DOUBLE::VARCHAR, revenue::VARCHAR, segment] FROM rw WHERE row_ix = 0),
gwide AS (SELECT task, 0 AS gold_ix, snapshot, row_ix, v FROM wide WHERE attempt = 'same'
  UNION ALL SELECT task, 1, snapshot, row_ix, v FROM wide WHERE attempt = 'far'),
p AS (SELECT task, attempt, snapshot, row_ix, i AS col, v[i] AS val FROM wide, range(1, 6) r(i) WHERE i <= len(v)),
g AS (SELECT task, gold_ix, snapshot, row_ix, i AS col, v[i] AS val FROM gwide, range(1, 5) r(i)),
pn AS (SELECT task, attempt, snapshot, count(DISTINCT row_ix) AS n FROM p GROUP BY ALL),
gn AS (SELECT task, gold_ix, snapshot, count(DISTINCT row_ix) AS n FROM g GROUP BY ALL),
po AS (SELECT *, CASE WHEN task % 2 = 0 THEN row_number() OVER (PARTITION BY task, attempt, snapshot, col ORDER BY val IS NULL,
  val, row_ix) - 1 ELSE row_ix END AS pos, TRY_CAST(val AS DOUBLE) AS x FROM p),
go AS (SELECT *, CASE WHEN task % 2 = 0 THEN row_number() OVER (PARTITION BY task, gold_ix, snapshot, col ORDER BY val IS NULL,
  val, row_ix) - 1 ELSE row_ix END AS pos, TRY_CAST(val AS DOUBLE) AS x FROM g),
colm AS (SELECT g.task, p.attempt, g.snapshot, g.gold_ix, g.col AS g_col, p.col AS p_col, bool_and(
   (g.val IS NULL AND p.val IS NULL) OR coalesce(g.val = p.val, false)
   OR coalesce(abs(g.x - p.x) <= greatest(1e-9 * greatest(abs(g.x), abs(p.x)), 0.01), false)) AS ok
  FROM go g JOIN po p ON p.task = g.task AND p.snapshot = g.snapshot AND p.pos = g.pos
  JOIN pn ON pn.task = p.task AND pn.attempt = p.attempt AND pn.snapshot = p.snapshot
  JOIN gn ON gn.task = g.task AND gn.gold_ix = g.gold_ix AND gn.snapshot = g.snapshot AND gn.n = pn.n GROUP BY ALL),
fnd AS (SELECT task, attempt, snapshot, gold_ix, g_col, bool_or(ok) AS ok FROM colm GROUP BY ALL),
jd AS (SELECT pn.task, pn.attempt, pn.snapshot, gn.gold_ix, gn.n AS g_rows, pn.n AS p_rows,
   count(*) FILTER (f.ok) AS hits, min(f.g_col) FILTER (NOT f.ok) AS miss
  FROM pn JOIN gn USING (task, snapshot) LEFT JOIN fnd f ON f.task = pn.task AND f.attempt = pn.attempt
   AND f.snapshot = pn.snapshot AND f.gold_ix = gn.gold_ix GROUP BY ALL)
"""

# the same with every fifth line count missing, and all that is missing read as 0
FILE_SQL = (
    ROWS_SQL.replace("rw AS (SELECT *,", "rw AS (SELECT * REPLACE (CASE WHEN row_ix % 5 <> 0 THEN n_lines END AS n_lines) FROM (SELECT *,")
    .replace("AS size FROM rows0)", "AS size FROM rows0))").replace("v[i] AS val", "coalesce(v[i], '0.0') AS val")
)

WHY_SQL = """CASE WHEN g_rows <> p_rows THEN 'row count gold=' || g_rows || ' pred=' || p_rows
  WHEN hits < 4 THEN 'gold column ' || (miss - 1) || ' not matched by any predicted column' ELSE '' END"""


# ---------------------------------------------------------------- comparison rules


@query(
    "cmp_normalise",
    f"""WITH {ROWS_SQL} SELECT attempt, CASE WHEN val IS NULL THEN 'null' WHEN x IS NOT NULL THEN 'num' ELSE 'str' END AS kind,
  count(*) AS cells, count(DISTINCT val) AS texts FROM po GROUP BY ALL""",
)
def cmp_normalise(t):
    cells = answers(gold_rows(t))
    texts = cells.groupBy("attempt", "kind", "val").agg(F.count("*").alias("k"))
    return texts.groupBy("attempt", "kind").agg(F.sum("k").alias("cells"), F.count("val").alias("texts"))


@query(
    "cmp_null_to_zero",
    f"""WITH {ROWS_SQL} SELECT attempt, count(*) FILTER (val IS NULL OR x = 0) AS zeros, count(*) AS cells FROM po
GROUP BY attempt""",
)
def cmp_null_to_zero(t):
    cells = cmp.null_to_zero(answers(gold_rows(t)), blank_too=False)
    return cells.groupBy("attempt").agg(F.count_if((c("kind") == "num") & (c("val") == cmp.ZERO)).alias("zeros"), F.count("*").alias("cells"))


@query(
    "cmp_cell_eq",
    f"""WITH {ROWS_SQL} SELECT p.attempt, p.col - 1 AS col_ix, count(*) FILTER (
   (g.val IS NULL AND p.val IS NULL) OR coalesce(g.val = p.val, false)
   OR coalesce(abs(g.x - p.x) <= greatest(1e-9 * greatest(abs(g.x), abs(p.x)), 0.01), false)) AS equal, count(*) AS n
FROM go g JOIN po p ON p.task = g.task AND p.snapshot = g.snapshot AND p.row_ix = g.row_ix AND p.col = g.col
WHERE gold_ix = 0 GROUP BY ALL""",
)
def cmp_cell_eq(t):
    from assayer.functions.cells import cells_equal, number_of

    rows = gold_rows(t)
    gold = golds(rows).where(c("gold_ix") == 0).withColumnRenamed("val", "g_val").drop("kind", "gold_ix")
    joined = answers(rows).join(gold, ["task", "snapshot", "row_ix", "col_ix"])
    read = joined.withColumns({"x": number_of(c("val")), "g_x": number_of(c("g_val"))})
    return read.groupBy("attempt", c("col_ix").cast("bigint").alias("col_ix")).agg(
        F.count_if(cells_equal(c("g_val"), c("val"), c("g_x"), c("x"))).alias("equal"), F.count("*").alias("n")
    )


@query(
    "cmp_column_vector",
    f"""WITH {ROWS_SQL} SELECT task, attempt, snapshot, CAST(g_col - 1 AS INTEGER) AS g_col, CAST(p_col - 1 AS INTEGER) AS p_col
FROM colm WHERE ok AND gold_ix = 0""",
)
def cmp_column_vector(t):
    gold, pred, gs, ps, tasks = setup(t)
    return cmp.column_matches(gold, pred, cmp.sized_pairs(gs, ps, tasks)).drop("gold_ix")


@query(
    "cmp_table",
    f"""WITH {ROWS_SQL} SELECT task, attempt, snapshot, g_rows = p_rows AND hits = 4 AS ok FROM jd WHERE gold_ix = 0""",
)
def cmp_table(t):
    judged = cmp.against_each_gold(*setup(t))
    return judged.select("task", "attempt", "snapshot", "ok")


@query(
    "cmp_multi_gold",
    f"""WITH {FILE_SQL}, k AS (SELECT task, attempt, snapshot, gold_ix, g_rows = p_rows
   AND (SELECT count(*) FROM fnd f WHERE f.task = jd.task AND f.attempt = jd.attempt AND f.snapshot = jd.snapshot
     AND f.gold_ix = jd.gold_ix AND f.ok AND f.g_col IN (1, CASE jd.gold_ix WHEN 0 THEN 2 ELSE 3 END)) = 2 AS ok FROM jd)
SELECT task, attempt, snapshot, bool_or(ok) AS ok, CAST(min(gold_ix) FILTER (ok) AS INTEGER) AS gold_ix FROM k GROUP BY ALL""",
)
def cmp_multi_gold(t):
    # the first gold is judged on customer and line count, the second on customer and revenue; missing cells count as 0
    return cmp.compare_tables(*setup(t, 2, "array(array(0, 1), array(0, 2))", gaps=True), "file").drop("why")


@query(
    "cmp_row_multiset",
    f"""WITH {ROWS_SQL}, pr AS (SELECT task, attempt, snapshot, list_transform(v, lambda x: coalesce(x, '0.0')) AS v FROM wide),
 pl AS (SELECT task, attempt, snapshot, list_sort(list(v::VARCHAR)) AS rs FROM pr GROUP BY ALL)
SELECT a.task, a.attempt, a.snapshot, a.rs = b.rs AS ok FROM pl a JOIN pl b ON b.task = a.task AND b.snapshot = a.snapshot
 AND b.attempt = 'same'""",
)
def cmp_row_multiset(t):
    gold, pred, gs, ps, tasks = setup(t)
    return cmp.same_row_multiset(gold, pred, cmp.sized_pairs(gs, ps, tasks)).drop("gold_ix")


@query(
    "cmp_strict",
    f"""WITH {ROWS_SQL}, ck AS (SELECT task, attempt, snapshot, col, CASE WHEN task % 2 = 0
   THEN string_agg(coalesce(val, '~'), '|' ORDER BY coalesce(val, '~'))
   ELSE string_agg(coalesce(val, '~'), '|' ORDER BY row_ix) END AS k FROM p GROUP BY task, attempt, snapshot, col),
 l AS (SELECT task, attempt, snapshot, list_sort(list(k)) AS ks FROM ck GROUP BY ALL)
SELECT a.task, a.attempt, a.snapshot, a.ks = b.ks AS ok FROM l a JOIN l b ON b.task = a.task AND b.snapshot = a.snapshot
 AND b.attempt = 'same'""",
)
def cmp_strict(t):
    gold, pred, gs, ps, tasks = setup(t)
    return cmp.same_columns_strict(gold, pred, cmp.sized_pairs(gs, ps, tasks), tasks).drop("gold_ix")


ORDER_GOLDS_SQL = """
og AS (SELECT o_custkey AS task, CAST(o_orderkey % 4 AS INTEGER) AS snapshot, count(*) AS k,
  CASE WHEN bool_or(o_orderstatus <> 'P') THEN CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) END AS filled
  FROM orders GROUP BY ALL),
gr AS (SELECT c_custkey AS task, CAST(s AS INTEGER) AS snapshot, k, filled FROM customer CROSS JOIN range(4) r(s)
  LEFT JOIN og ON og.task = c_custkey AND og.snapshot = s)
"""


def order_golds(t):
    """Per customer and quarter of the orders: one cell with the filled orders, missing when all are partial,
    and no rows when the customer has no order there."""
    filled = F.when(F.bool_or(c("o_orderstatus") != "P"), F.count_if(c("o_orderstatus") == "F").cast("double"))
    found = t.orders.groupBy(
        c("o_custkey").alias("task"), (c("o_orderkey") % 4).cast("int").alias("snapshot")
    ).agg(filled.alias("filled"))
    gold = cmp.to_cells(
        found.withColumn("gold_ix", F.lit(0)).withColumn("row_ix", F.lit(0).cast("bigint")), cmp.GOLD, ["filled"]
    )
    every = t.customer.select(
        c("c_custkey").alias("task"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("snapshot"), F.lit(0).alias("gold_ix")
    )
    sizes = cmp.shapes_of(gold, cmp.GOLD)
    shape = every.join(sizes, cmp.GOLD, "left").fillna(0, ["n_rows"]).fillna(1, ["n_cols"])
    return gold, shape


@query(
    "cmp_empty_gold_flag",
    f"""WITH {ORDER_GOLDS_SQL} SELECT snapshot, count(*) FILTER (k IS NULL) AS empty,
  count(*) FILTER (k IS NOT NULL AND (filled IS NULL OR filled IN (0, 1))) AS trivial FROM gr GROUP BY snapshot""",
)
def cmp_empty_gold_flag(t):
    flags = cmp.weak_golds(*order_golds(t))
    return flags.groupBy("snapshot").agg(F.count_if("empty").alias("empty"), F.count_if("trivial").alias("trivial"))


@query(
    "drop_degenerate_gold",
    f"""WITH {ORDER_GOLDS_SQL} SELECT task, snapshot FROM gr WHERE k IS NOT NULL AND filled <> 0""",
)
def drop_degenerate_gold(t):
    return cmp.weak_golds(*order_golds(t)).where(~c("degenerate")).select("task", "snapshot")


@query(
    "cmp_reason",
    f"""WITH {ROWS_SQL} SELECT task, attempt, snapshot, {WHY_SQL} AS why FROM jd WHERE gold_ix = 0""",
)
def cmp_reason(t):
    return cmp.against_each_gold(*setup(t)).select("task", "attempt", "snapshot", "why")


# ---------------------------------------------------------------- verdicts


@query(
    "lad_all_snapshots",
    f"""WITH {ROWS_SQL}, k AS (SELECT task, attempt, snapshot, g_rows = p_rows AND hits = 4 AS ok FROM jd WHERE gold_ix = 0)
SELECT task, attempt, bool_and(ok) AS passed, min(snapshot) FILTER (NOT ok) AS first_failed FROM k
WHERE snapshot IN (1, 2) GROUP BY ALL""",
)
def lad_all_snapshots(t):
    return lad.all_snapshots(cmp.against_each_gold(*setup(t)), [1, 2])


# what is handed in: kind of text, then one statement, reads only, has FROM, unknown tables, reads a table. A text is
# the episode's own with something appended or instead of FROM orders, or one of its own
TEXTS = [
    ("append", "; DROP TABLE orders", False, True, True, 0, True),
    ("text", "UPDATE orders SET o_custkey = 0", True, False, False, 0, False),
    ("text", "SELECT 3 AS n", True, True, False, 0, False),
    ("instead", "FROM missing", True, True, True, 1, True),
    ("append", " -- '; x", True, True, True, 0, True),
    ("instead", 'FROM orders o, "absent" a', True, True, True, 1, True),
    ("text", "SELECT extract(year FROM DATE '2020-01-01') /* ; */", True, True, False, 0, False),
    ("append", "", True, True, True, 0, True),
    ("text", "SELECT count(*) FROM orders WHERE o_orderstatus IS DISTINCT FROM o_orderpriority", True, True, True, 0, True),
    ("text", "SELECT trim(both ' ' from 'x')", True, True, False, 0, False),
    ("text", "SELECT * FROM unnest([1, 2]) u(x), range(5)", True, True, True, 0, False),
    ("text", "SELECT * FROM orders, (SELECT 1) q, missing", True, True, True, 1, True),
    ("text", 'SELECT ";" FROM orders;', True, True, True, 0, True),
    ("text", "WITH a AS (SELECT 1), b (x) AS MATERIALIZED (SELECT * FROM a) SELECT * FROM b JOIN (orders o CROSS JOIN elsewhere) ON true",
     True, True, True, 1, True),
    ("text", "WITH x AS (SELECT 1) DELETE FROM orders", True, False, True, 0, True),
    ("text", "(SELECT 1) UNION ALL SELECT count(*) FROM main.lineitem -- done", True, True, True, 0, True),
    ("append", " /* 'open */", True, True, True, 0, True),
]


# the check does not look at the texts: it states what is known of each kind
TEXTS_SQL = f"""{EPISODES_SQL}, known(kind, one_statement, reads_only, has_from, unknown, reads_table) AS (VALUES
  {", ".join(f"({i}, {one}, {reads}, {has}, {unknown}, {table})" for i, (_, _, one, reads, has, unknown, table) in enumerate(TEXTS))}),
sn AS (SELECT episode, task, one_statement, reads_only, has_from, reads_table,
   CAST(CASE WHEN kind IN ({", ".join(str(i) for i, x in enumerate(TEXTS) if x[0] == "instead")}) AND sql NOT LIKE '%FROM orders%'
     THEN 0 ELSE unknown END AS INTEGER) AS unknown_tables
  FROM e JOIN known ON kind = episode % {len(TEXTS)} WHERE sql IS NOT NULL)"""


def submitted_texts(t):
    text = c("sql")
    for i, (how, said, *_) in enumerate(TEXTS):
        made = {
            "append": F.concat(c("sql"), F.lit(said)), "text": F.lit(said),
            "instead": F.replace("sql", F.lit("FROM orders"), F.lit(said)),
        }[how]
        text = F.when(c("episode") % len(TEXTS) == i, made).otherwise(text)
    rows = episodes(t).where(c("sql").isNotNull()).select("episode", "task", "arm", "passed", text.alias("sql"))
    return lad.screen(rows, "sql", CATALOG)


@query(
    "lad_text_screen",
    f"WITH {TEXTS_SQL} SELECT episode, one_statement, reads_only, has_from, unknown_tables FROM sn",
)
def lad_text_screen(t):
    return submitted_texts(t).select("episode", "one_statement", "reads_only", "has_from", "unknown_tables")


# the text handed in with each kind of answer, and the gate it stops at; kinds not named have the first
TEXT_OF = {
    "": ('SELECT c_custkey, count(*) FROM orders o, "lineitem" l, customer -- one statement\nGROUP BY 1', ""),
    "doubled": ("DELETE FROM orders", "G0"),
    "reversed rows": ("SELECT extract(year FROM o_orderdate) FROM orders JOIN elsewhere ON true", "G1"),
    "permuted": ("WITH elsewhere AS (SELECT 'a; b' FROM main.orders) SELECT * FROM elsewhere;", ""),
}
ROW_CAP = 10_000  # fixed value: a longer result is an error


@query(
    "lad_first_failed_gate",
    f"""WITH {ROWS_SQL}, sn AS (SELECT DISTINCT task, attempt, CASE attempt
    {" ".join(f"WHEN '{kind}' THEN '{gate}'" for kind, (_, gate) in TEXT_OF.items() if gate)} ELSE '' END AS stop FROM pn),
 ev AS (SELECT task, attempt, snapshot, CASE WHEN p_rows > {ROW_CAP} THEN 'G3' WHEN NOT (g_rows = p_rows AND hits = 4) THEN 'G4'
   END AS gate, CASE WHEN p_rows > {ROW_CAP} THEN 'too many rows' ELSE {WHY_SQL} END AS why
  FROM jd WHERE gold_ix = 0 AND snapshot IN (1, 2)),
 gone AS (SELECT s.task, s.attempt, CAST(r.s AS INTEGER) AS snapshot, CASE WHEN ev.task IS NULL THEN 'G3' ELSE ev.gate END AS gate,
   CASE WHEN ev.task IS NULL THEN 'no result' ELSE why END AS why FROM sn s CROSS JOIN range(1, 3) r(s)
   LEFT JOIN ev ON ev.task = s.task AND ev.attempt = s.attempt AND ev.snapshot = r.s),
 fe AS (SELECT * FROM gone WHERE gate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, attempt ORDER BY snapshot) = 1)
SELECT task, attempt, CASE WHEN stop <> '' THEN stop ELSE fe.gate END AS gate, CASE WHEN stop = '' THEN snapshot END AS snapshot,
  CASE stop WHEN 'G0' THEN 'not one statement that reads' WHEN 'G1' THEN 'unknown table' ELSE coalesce(why, '') END AS why,
  stop = '' AND fe.gate IS NULL AS passed
FROM sn LEFT JOIN fe USING (task, attempt)""",
)
def lad_first_failed_gate(t):
    gold, pred, gold_shape, pred_shape, tasks = setup(t)
    judged = cmp.against_each_gold(gold, pred, gold_shape, pred_shape, tasks)
    text = F.lit(TEXT_OF[""][0])
    for kind, (sql, _) in TEXT_OF.items():
        text = F.when(c("attempt") == kind, sql).otherwise(text)
    attempts = pred_shape.select("task", "attempt").distinct().withColumn("sql", text)
    results = lad.bounded_results(pred_shape, ROW_CAP)
    return lad.ladder(judged, lad.screen(attempts, "sql", CATALOG), results, [1, 2])


@query(
    "lad_hardcode_flag",
    f"""WITH {TEXTS_SQL}, m AS (SELECT task, count(*) AS snapshots, count(DISTINCT fingerprint) AS results FROM
  (SELECT o_custkey AS task, o_orderstatus AS snapshot, count(*) AS fingerprint FROM orders GROUP BY ALL) GROUP BY task)
SELECT episode, NOT reads_table OR coalesce(snapshots > 1 AND results = 1, false) AS hardcoded FROM sn LEFT JOIN m USING (task)""",
)
def lad_hardcode_flag(t):
    # the answer of a task on a snapshot: the number of its orders with that status
    found = t.orders.groupBy(c("o_custkey").alias("task"), c("o_orderstatus").alias("snapshot")).agg(
        F.count("*").alias("answer")
    )
    cells = cmp.to_cells(found.withColumn("row_ix", F.lit(0).cast("bigint")), ["task", "snapshot"], ["answer"])
    prints = cmp.fingerprints(cells, ["task", "snapshot"])
    return lad.hardcoded(submitted_texts(t), prints, ["task"]).select("episode", "hardcoded")


@query(
    "lad_gold_selfcheck",
    f"""WITH {ORDER_GOLDS_SQL}, f AS (SELECT a.task, count(*) FILTER (b.filled IS NOT DISTINCT FROM a.filled) AS repeats
   FROM og a JOIN og b ON b.task = a.task AND b.snapshot > 0 WHERE a.snapshot = 0 GROUP BY a.task)
SELECT c_custkey AS task,
  NOT EXISTS (SELECT 1 FROM gr a JOIN gr b ON b.task = a.task AND b.snapshot = a.snapshot WHERE a.task = c_custkey
    AND (a.k IS NULL) <> (b.k IS NULL) OR (a.task = c_custkey AND a.filled IS DISTINCT FROM b.filled)) AS passes_itself,
  EXISTS (SELECT 1 FROM og WHERE og.task = c_custkey AND snapshot = 0) AS has_rows,
  coalesce((SELECT repeats FROM f WHERE f.task = c_custkey), 0) < 3 AS frozen_fails FROM customer""",
)
def lad_gold_selfcheck(t):
    gold, shape = order_golds(t)
    pred, pred_shape = (
        x.withColumn("attempt", F.lit("gold")).drop("gold_ix") for x in (gold, shape)
    )
    tasks = t.customer.select(
        c("c_custkey").alias("task"), F.lit(True).alias("ignore_order"),
        F.expr("CAST(array() AS ARRAY<ARRAY<INT>>)").alias("condition_cols"),
    )
    judged = cmp.against_each_gold(gold, pred, shape, pred_shape, tasks)
    return lad.gold_selfcheck(judged, cmp.fingerprints(gold, ["task", "snapshot"]), 0, [1, 2, 3])
