"""Transcript queries on the conversations, with call and SQL markup put around the assistant text."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import transcripts as tx
from assayer.operators.ranking import number_rows
from assayer.registry import query

c = F.col
CAP = 4

# ---------------------------------------------------------------- the turns

RUN = "<tool_call>\n<function=run_sql>\n<parameter=sql>\n%s\n</parameter>\n</function>\n</tool_call>"
SUBMIT = RUN.replace("run_sql", "submit")
OTHER = "<tool_call> <function=list_tables> <parameter=a>x</parameter><parameter=a>y</parameter> </function> </tool_call>"


def turns(t):
    """Assistant turns by (conversation + turn) mod 9: SQL only in thinking, a call in thinking, calls and a submission,
    a truncated turn, a fenced submission, an unknown tool."""
    m = (c("conv_id") + c("turn")) % 9
    text, n = c("text"), c("turn").cast("string")

    def markup(pattern, value):
        head, tail = pattern.split("%s")
        return F.concat(F.lit(head), value, F.lit(tail))

    raw = (
        F.when(m.isin(0, 5), F.concat(F.lit("<think>"), text, F.lit(" ```sql\nSELECT 1\n``` </think> Still thinking.")))
        .when(m.isin(1, 6), F.concat(F.lit("<think>"), text, markup(RUN, F.concat(F.lit("SELECT "), n))))
        .when(
            m == 2,
            F.concat(
                F.lit("<think>done</think> "), text, markup(RUN, F.lit("SELECT 2")),
                markup(SUBMIT, F.concat(F.lit("SELECT "), c("conv_id").cast("string"))), markup(RUN, F.lit("SELECT 3")),
            ),
        )
        .when(m.isin(3, 7), F.concat(F.lit("<think>"), text))
        .when(m == 4, F.concat(F.lit("<think>ok</think>"), text, F.lit("\n```SQL\nSELECT 0\n``` and ```sql\nSELECT "), n, F.lit("\n```")))
        .otherwise(F.concat(F.lit("<think>look</think>"), F.lit(OTHER), text))
    )
    return t.conversations.select(
        "conv_id", "turn", "role", F.when(c("role") == "assistant", raw).otherwise(text).alias("raw")
    )


def lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def sql_markup(pattern: str, value: str) -> str:
    head, tail = pattern.split("%s")
    return f"{lit(head)} || {value} || {lit(tail)}"


TURNS_SQL = f"""
tu AS (SELECT conv_id, turn, role, CASE WHEN role <> 'assistant' THEN text ELSE CASE (conv_id + turn) % 9
  WHEN 0 THEN '<think>' || text || {lit(" ```sql" + chr(10) + "SELECT 1" + chr(10) + "``` </think> Still thinking.")}
  WHEN 5 THEN '<think>' || text || {lit(" ```sql" + chr(10) + "SELECT 1" + chr(10) + "``` </think> Still thinking.")}
  WHEN 1 THEN '<think>' || text || {sql_markup(RUN, "'SELECT ' || turn")}
  WHEN 6 THEN '<think>' || text || {sql_markup(RUN, "'SELECT ' || turn")}
  WHEN 2 THEN '<think>done</think> ' || text || {sql_markup(RUN, "'SELECT 2'")} || {sql_markup(SUBMIT, "'SELECT ' || conv_id")}
    || {sql_markup(RUN, "'SELECT 3'")}
  WHEN 3 THEN '<think>' || text WHEN 7 THEN '<think>' || text
  WHEN 4 THEN '<think>ok</think>' || text || {lit(chr(10) + "```SQL" + chr(10) + "SELECT 0" + chr(10) + "``` and ```sql" + chr(10) + "SELECT ")} || turn || chr(10) || '```'
  ELSE '<think>look</think>' || {lit(OTHER)} || text END END AS raw FROM conversations),
sp AS (SELECT *, strpos(raw, '</think>') AS cut, ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11) AS bl FROM tu),
th AS (SELECT conv_id, turn, role, raw, bl, CASE WHEN cut = 0 THEN raw ELSE trim(replace(substr(raw, 1, cut - 1), '<think>', ''), bl)
   END AS thinking, CASE WHEN cut = 0 THEN '' ELSE trim(substr(raw, cut + 8), bl) END AS answer FROM sp),
nm AS (SELECT *, regexp_extract_all(answer, '<tool_call>\\s*<function=([^>]+)>(.*?)</function>\\s*</tool_call>', 1, 's') AS an,
  regexp_extract_all(answer, '<tool_call>\\s*<function=([^>]+)>(.*?)</function>\\s*</tool_call>', 2, 's') AS ab,
  regexp_extract_all(thinking, '<tool_call>\\s*<function=([^>]+)>(.*?)</function>\\s*</tool_call>', 1, 's') AS tn,
  regexp_extract_all(thinking, '<tool_call>\\s*<function=([^>]+)>(.*?)</function>\\s*</tool_call>', 2, 's') AS tb,
  trim(regexp_extract_all(answer, '```sql\\s*(.*?)```', 1, 'si')[-1], bl) AS sql_block FROM th),
pa AS (SELECT conv_id, turn, role, raw, thinking, answer, sql_block, CASE WHEN len(an) > 0 THEN an ELSE tn END AS names,
  CASE WHEN len(an) > 0 THEN ab ELSE tb END AS bodies FROM nm),
ac AS (SELECT *, CASE WHEN len(names) > 0 THEN 'tool' WHEN length(sql_block) > 0 THEN 'text' ELSE 'note' END AS action,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM pa WHERE role = 'assistant')
"""


def assistant(t):
    return turns(t).where(c("role") == "assistant")


@query(
    "tx_parse_calls",
    f"""WITH {TURNS_SQL}, x AS (SELECT conv_id, turn, names, bodies, unnest(range(1, len(names) + 1)) AS i FROM ac),
 y AS (SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS ix, trim(names[i]) AS name,
  regexp_extract_all(bodies[i], '<parameter=([^>]+)>\\n?(.*?)\\n?</parameter>', 1, 's') AS ks,
  regexp_extract_all(bodies[i], '<parameter=([^>]+)>\\n?(.*?)\\n?</parameter>', 2, 's') AS vs FROM x)
SELECT conv_id, turn, ix, name, CASE WHEN list_contains(ks, 'sql') THEN vs[list_position(ks, 'sql')] END AS sql,
  CASE WHEN list_contains(ks, 'a') THEN vs[len(ks)] END AS a FROM y""",
)
def tx_parse_calls(t):
    calls = tx.parse_turns(assistant(t)).select("conv_id", "turn", F.posexplode("calls").alias("ix", "call"))
    return calls.select(
        "conv_id", "turn", "ix", c("call.name").alias("name"),
        F.try_element_at("call.args", F.lit("sql")).alias("sql"), F.try_element_at("call.args", F.lit("a")).alias("a"),
    )


@query(
    "tx_split_thinking",
    f"WITH {TURNS_SQL} SELECT conv_id, turn, md5(thinking) AS thinking, md5(answer) AS answer FROM th WHERE role = 'assistant'",
)
def tx_split_thinking(t):
    thinking, answer = tx.split_thinking(c("raw"))
    return assistant(t).select("conv_id", "turn", F.md5(thinking).alias("thinking"), F.md5(answer).alias("answer"))


@query("tx_last_sql_block", f"WITH {TURNS_SQL} SELECT conv_id, turn, sql_block FROM ac WHERE sql_block IS NOT NULL")
def tx_last_sql_block(t):
    _, answer = tx.split_thinking(c("raw"))
    blocks = assistant(t).select("conv_id", "turn", tx.last_sql_block(answer).alias("sql_block"))
    return blocks.where(c("sql_block").isNotNull())


@query("tx_turn_rule", f"WITH {TURNS_SQL} SELECT conv_id, turn, action, len(names) AS n_calls FROM ac")
def tx_turn_rule(t):
    return tx.parse_turns(assistant(t)).select(
        "conv_id", "turn", "action", F.size("calls").cast("bigint").alias("n_calls")
    )


@query(
    "tx_episode_fold",
    f"""WITH {TURNS_SQL}, k AS (SELECT *, coalesce(list_position(names, 'submit'), 0) AS cut FROM ac WHERE turn_no <= {CAP}),
 f AS (SELECT conv_id, min(turn_no) AS first FROM k WHERE cut > 0 OR action = 'text' GROUP BY conv_id),
 u AS (SELECT k.*, first, CASE WHEN cut > 0 THEN names[1:cut] ELSE names END AS counted FROM k LEFT JOIN f USING (conv_id)
  WHERE first IS NULL OR turn_no <= first)
SELECT conv_id, max(turn_no) AS turns, CAST(sum(len(counted)) AS BIGINT) AS n_calls,
  CAST(sum(len(list_filter(counted, lambda x: x = 'run_sql'))) AS BIGINT) AS n_run_sql,
  max(CASE WHEN turn_no = first THEN CASE WHEN cut > 0 THEN 'tool' ELSE 'text' END END) AS via,
  max(CASE WHEN turn_no = first THEN CASE WHEN cut > 0 THEN 'SELECT ' || conv_id ELSE sql_block END END) AS submitted_sql,
  max(first) IS NULL AND max(turn_no) >= {CAP} AS hit_cap FROM u GROUP BY conv_id""",
)
def tx_episode_fold(t):
    return tx.fold_episodes(tx.parse_turns(tx.numbered(turns(t))), CAP)


@query(
    "tx_turns_left",
    f"""WITH {TURNS_SQL} SELECT conv_id, turn, 8 - turn_no AS "left", CASE WHEN 8 - turn_no > 5 THEN 'none'
  WHEN 8 - turn_no <= 1 THEN 'last' ELSE 'low' END AS note FROM ac""",
)
def tx_turns_left(t):
    return tx.turns_left(tx.turn_numbers(turns(t)), 8)


SPANS_SQL = f"""{TURNS_SQL}, ss AS (SELECT conv_id, turn, role, length(raw) AS n, CAST(sum(length(raw)) OVER (PARTITION BY conv_id
  ORDER BY turn) AS BIGINT) AS ends FROM tu)"""


@query(
    "tx_segment_mask",
    f"""WITH {SPANS_SQL} SELECT conv_id, turn, ends - n AS starts, ends, role = 'assistant' AS generated FROM ss""",
)
def tx_segment_mask(t):
    return tx.segment_spans(turns(t))


@query(
    "tx_generated_chars",
    f"""WITH {SPANS_SQL} SELECT conv_id, max(ends) AS chars, coalesce(CAST(sum(n) FILTER (role = 'assistant') AS BIGINT), 0)
  AS generated_chars FROM ss GROUP BY conv_id""",
)
def tx_generated_chars(t):
    # without the spans this is a plain sum, so no running total is formed
    size = F.length("raw").cast("bigint")
    return turns(t).groupBy("conv_id").agg(
        F.sum(size).alias("chars"), F.sum(F.when(c("role") == "assistant", size).otherwise(0)).alias("generated_chars")
    )


@query(
    "tx_context_guard",
    f"""WITH {SPANS_SQL} SELECT conv_id, min(turn) AS turn, min(ends - n) AS prompt_chars FROM ss
WHERE role = 'assistant' AND ends - n + 400 > 1500 GROUP BY conv_id""",
)
def tx_context_guard(t):
    return tx.context_breach(tx.segment_spans(turns(t)), 1500, 400)


@query(
    "tx_history_variants",
    f"""WITH {TURNS_SQL} SELECT conv_id, CAST(sum(length(raw)) AS BIGINT) AS with_thinking,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(answer) ELSE length(raw) END) AS BIGINT) AS without_thinking,
  CAST(sum(CASE WHEN role = 'assistant' AND len(names) > 0 THEN 2 ELSE 1 END) AS BIGINT) AS merged_messages,
  CAST(sum(CASE WHEN role = 'assistant' THEN 1 + len(names) ELSE 1 END) AS BIGINT) AS per_call_messages
FROM pa GROUP BY conv_id""",
)
def tx_history_variants(t):
    return tx.history_sizes(tx.parse_turns(turns(t)))


@query(
    "tx_result_preview",
    """
WITH r AS (SELECT n_nationkey AS task, c_custkey, c_name, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS segment,
  row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS ix, count(c_custkey) OVER (PARTITION BY n_nationkey) AS n
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND n_nationkey % 8 <> 3),
 g AS (SELECT task, max(n) AS n, string_agg(c_custkey || ' | ' || c_name || ' | ' || coalesce(segment, 'NULL'), chr(10) ORDER BY ix)
  FILTER (ix < 20) AS body FROM r GROUP BY task)
SELECT task, CASE WHEN task % 8 = 5 THEN 'ERROR: no such column' WHEN n = 0 THEN 'columns: [''key'', ''name'', ''segment'']' || chr(10)
  || '(0 rows)' ELSE substr('key | name | segment' || chr(10) || body || CASE WHEN n > 20 THEN chr(10) || '... (' || n
  || ' rows total, showing 20)' ELSE chr(10) || '(' || n || ' rows)' END, 1, 1500) END AS preview FROM g""",
)
def tx_result_preview(t):
    columns = ["key", "name", "segment"]
    rows = t.customer.where(c("c_nationkey") % 8 != 3).select(
        c("c_nationkey").alias("task"), c("c_custkey").alias("key"), c("c_name").alias("name"),
        F.when(c("c_custkey") % 4 > 0, c("c_mktsegment")).alias("segment"),
    )
    placed = number_rows(rows, ["task"], ["key"], "row_no").select(
        "task", (c("row_no") - 1).alias("row_ix"), tx.line_of(columns).alias("line")
    )
    found = placed.groupBy("task").agg(F.count("*").alias("n_rows"))
    error = F.when(c("task") % 8 == 5, "no such column").alias("error")
    sizes = t.nation.select(c("n_nationkey").alias("task")).join(found, "task", "left").fillna(0, ["n_rows"])
    return tx.result_preview(placed, ["task"], columns, sizes.select("task", "n_rows", error))
