"""Conversation turns: tool calls, thinking, submissions and the fold of turns into episodes.

A turn has ``conv_id, turn, role, raw``. A conversation of any length is folded with aggregates and running sums that
cut it into stretches; no task holds a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.ranking import number_rows, running_totals

c = F.col

# fixed values: the markup of calls, parameters, thinking and SQL blocks
CALL = r"(?s)<tool_call>\s*<function=([^>]+)>(.*?)</function>\s*</tool_call>"
PARAMETER = r"(?s)<parameter=([^>]+)>\n?(.*?)\n?</parameter>"
SQL_BLOCK = r"(?is)```sql\s*(.*?)```"
THINK, END_THINK = "<think>", "</think>"
BLANK = " \t\r\n\f\u000b"

# fixed values: notes start at this many turns left; previews show this many rows and characters
NOTE_TURNS = 5
PREVIEW_ROWS, PREVIEW_CHARS = 20, 1500


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def calls_of(text: Column) -> Column:
    """All calls in the text as ``(name, args)``; a repeated parameter keeps its last value."""
    names = F.regexp_extract_all(text, F.lit(CALL), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(CALL), F.lit(2))

    def call(name, body):
        keys = F.regexp_extract_all(body, F.lit(PARAMETER), F.lit(1))
        values = F.regexp_extract_all(body, F.lit(PARAMETER), F.lit(2))
        return F.struct(strip(name).alias("name"), F.map_from_arrays(keys, values).alias("args"))

    return F.zip_with(names, bodies, call)


def split_thinking(raw: Column) -> tuple[Column, Column]:
    """Text before and after the first end of thinking; without one, all of it is thinking."""
    at = F.instr(raw, END_THINK)
    before = strip(F.replace(F.substring(raw, F.lit(1), at - 1), F.lit(THINK), F.lit("")))
    after = strip(F.substring(raw, at + len(END_THINK), F.length(raw)))
    return F.when(at == 0, raw).otherwise(before), F.when(at == 0, "").otherwise(after)


def last_sql_block(answer: Column) -> Column:
    return strip(F.try_element_at(F.regexp_extract_all(answer, F.lit(SQL_BLOCK), F.lit(1)), F.lit(-1)))


def parse_turns(turns: DataFrame) -> DataFrame:
    """Add thinking, answer, calls and what the turn does: ``tool``, ``text`` (a submission) or ``note``.

    Calls come from the answer, else from the thinking. Without a call, an SQL block in the answer is a
    submission; one in the thinking is not.
    """
    thinking, answer = split_thinking(c("raw"))
    split = turns.withColumns({"thinking": thinking, "answer": answer})
    in_answer, in_thinking = calls_of(c("answer")), calls_of(c("thinking"))
    parsed = split.withColumn("calls", F.when(F.size(in_answer) > 0, in_answer).otherwise(in_thinking))
    parsed = parsed.withColumn("sql_block", last_sql_block(c("answer")))
    action = (
        F.when(F.size("calls") > 0, "tool").when(F.length("sql_block") > 0, "text").otherwise("note")
    )
    return parsed.withColumn("action", action)


def turn_numbers(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, turn_no``: the assistant turns from 1; no text goes through the numbering."""
    own = turns.where(c("role") == "assistant").select("conv_id", "turn")
    return number_rows(own, ["conv_id"], ["turn"], "turn_no")


def numbered(turns: DataFrame) -> DataFrame:
    """Assistant turns with their number; ``conv_id, turn`` names one turn."""
    return turns.where(c("role") == "assistant").join(turn_numbers(turns), ["conv_id", "turn"])


def fold_episodes(parsed: DataFrame, max_turns: int) -> DataFrame:
    """One row per conversation from its numbered, parsed assistant turns.

    The first submission within the cap ends the episode; later turns and later calls of that turn do not count.
    """
    at = F.array_position(F.transform("calls", lambda x: x["name"]), "submit")
    submit = F.get("calls", (at - 1).cast("int"))
    counted = F.when(at > 0, F.slice("calls", F.lit(1), at.cast("int"))).otherwise(c("calls"))
    flags = parsed.where(c("turn_no") <= max_turns).select(
        "conv_id",
        "turn_no",
        F.when(at > 0, "tool").when(c("action") == "text", "text").alias("via"),
        F.when(at > 0, F.coalesce(F.try_element_at(submit["args"], F.lit("sql")), F.lit("")))
        .when(c("action") == "text", c("sql_block"))
        .alias("sql"),
        F.size(counted).alias("n_calls"),
        F.size(F.filter(counted, lambda x: x["name"] == "run_sql")).alias("n_run_sql"),
    )
    first = flags.where(c("via").isNotNull()).groupBy("conv_id").agg(
        F.min_by(F.struct("turn_no", "via", "sql"), "turn_no").alias("s")
    )
    kept = flags.drop("via", "sql").join(first, "conv_id", "left").where(
        c("s").isNull() | (c("turn_no") <= c("s.turn_no"))
    )
    return (
        kept.groupBy("conv_id")
        .agg(
            F.max("turn_no").alias("turns"),
            F.sum("n_calls").alias("n_calls"),
            F.sum("n_run_sql").alias("n_run_sql"),
            F.first("s").alias("s"),
        )
        .select(
            "conv_id", "turns", "n_calls", "n_run_sql", c("s.via").alias("via"), c("s.sql").alias("submitted_sql"),
            (c("s").isNull() & (c("turns") >= max_turns)).alias("hit_cap"),
        )
    )


def turns_left(numbered_turns: DataFrame, cap: int) -> DataFrame:
    left = F.lit(cap) - c("turn_no")
    kind = F.when(left > NOTE_TURNS, "none").when(left <= 1, "last").otherwise("low")
    return numbered_turns.select("conv_id", "turn", left.alias("left"), kind.alias("note"))


def segment_spans(turns: DataFrame) -> DataFrame:
    """Character span of every turn in the joined text, and whether it was generated."""
    sizes = turns.select("conv_id", "turn", "role", F.length("raw").cast("bigint").alias("size"))
    spans = running_totals(sizes, ["conv_id"], ["turn"], ends=c("size"))
    return spans.select(
        "conv_id",
        "turn",
        (c("ends") - c("size")).alias("starts"),
        "ends",
        (c("role") == "assistant").alias("generated"),
    )


def generated_chars(spans: DataFrame) -> DataFrame:
    size = c("ends") - c("starts")
    return spans.groupBy("conv_id").agg(
        F.sum(size).alias("chars"), F.sum(F.when(c("generated"), size).otherwise(0)).alias("generated_chars")
    )


def context_breach(spans: DataFrame, limit: int, reserve: int) -> DataFrame:
    """The first generated turn whose prompt leaves less than ``reserve`` of ``limit``."""
    over = spans.where(c("generated") & (c("starts") + reserve > limit))
    return over.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min("starts").alias("prompt_chars"))


def history_sizes(parsed: DataFrame) -> DataFrame:
    """Size of the history with and without earlier thinking, and its messages with merged or per-call results.

    ``parsed`` holds all turns; only assistant turns have thinking and calls.
    """
    size = F.length("raw")
    own = c("role") == "assistant"
    calls = F.when(own, F.size("calls")).otherwise(0)
    return parsed.groupBy("conv_id").agg(
        F.sum(size).alias("with_thinking"),
        F.sum(F.when(own, F.length("answer")).otherwise(size)).alias("without_thinking"),
        F.sum(1 + F.when(calls > 0, 1).otherwise(0)).alias("merged_messages"),
        F.sum(1 + calls).alias("per_call_messages"),
    )


def result_preview(rows: DataFrame, keys: list[str], columns: list[str], sizes: DataFrame) -> DataFrame:
    """Text shown for a stored result: its error, no rows, or the first rows and the count, cut in length.

    ``rows`` has ``row_ix`` and ``line`` (cells joined by `` | ``). ``sizes`` has one row per result with ``n_rows`` and
    ``error``. Only the first rows of a result are gathered.
    """
    top = rows.where(c("row_ix") < PREVIEW_ROWS).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("row_ix", "line"))).alias("top")
    )
    body = F.array_join(F.transform("top", lambda x: x["line"]), "\n")
    more = F.when(
        c("n_rows") > PREVIEW_ROWS, F.format_string(f"\n... (%d rows total, showing {PREVIEW_ROWS})", "n_rows")
    ).otherwise(F.format_string("\n(%d rows)", "n_rows"))
    shown = F.concat(F.lit(" | ".join(columns) + "\n"), body, more)
    listed = ", ".join(f"'{x}'" for x in columns)
    none = F.lit(f"columns: [{listed}]\n(0 rows)")
    text = (
        F.when(c("error").isNotNull(), F.concat(F.lit("ERROR: "), c("error")))
        .when(c("n_rows") == 0, none)
        .otherwise(F.substring(shown, 1, PREVIEW_CHARS))
    )
    return sizes.join(top, keys, "left").select(*keys, text.alias("preview"))


def line_of(columns: list[str]) -> Column:
    """Cells of a row joined for a preview, missing ones as NULL."""
    return F.concat_ws(" | ", *[F.coalesce(c(x).cast("string"), F.lit("NULL")) for x in columns])
