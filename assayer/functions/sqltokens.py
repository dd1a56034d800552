"""SQL text as a list of tokens, and a fold over them that says which tables a text reads. A screen, not a parser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_HEADS = ("select", "with", "from")
#: Words that end the list of tables a FROM began.
AFTER_TABLES = (
    "where", "group", "having", "order", "limit", "union", "intersect", "except", "window", "qualify", "fetch", "offset", "select",
)
WRITES = ("insert", "update", "delete", "merge")
#: Words before a bracket that do not make it a list of arguments.
NO_FUNCTION = (
    "select", "distinct", "all", "from", "join", "lateral", "on", "using", "where", "and", "or", "not", "in", "exists", "any", "some",
    "as", "materialized", "by", "having", "when", "then", "else", "case", "union", "intersect", "except", "over", "filter", "limit",
    "values", "like", "between", "is", "with", "recursive", "qualify", "offset",
)
NAME = r"""(?:[\p{L}_][\p{L}\p{N}_$]*|"(?:[^"]|"")*"|`[^`]*`)"""
DOTTED = rf"{NAME}(?:\s*\.\s*{NAME})*"
# the first of these that fits at a place takes the text, so quotes in comments and comment marks in quotes mean nothing
TOKEN = "|".join([
    r"--[^\n]*|/\*[\s\S]*?\*/", r"'(?:[^']|'')*'|\$\$[\s\S]*?\$\$", r"is\s+(?:not\s+)?distinct\s+from\b",
    rf"(?!(?:{'|'.join(NO_FUNCTION)})\b){DOTTED}\s*\(", DOTTED, r"[0-9][\p{L}\p{N}_.]*", r"[(),;]",
])
NOTHING = r"^(?:--|/\*|is\s|[0-9])"
#: What a name stands behind where it may be that of a table.
BEFORE_NAMES = ("from", "join", "lateral", "with", "recursive", ",", "(")
KEPT = ("values", "(", ")", ",", *BEFORE_NAMES, *AFTER_TABLES, *WRITES)


def tokens(sql: Column) -> Column:
    """Names, dotted ones whole, in lower case; ``name(`` where arguments follow; ``'`` for a literal; brackets, commas
    and semicolons. Comments, numbers, other signs and IS DISTINCT FROM are left out; a null text has no tokens."""
    found = F.regexp_extract_all(F.lower(F.coalesce(sql, F.lit(""))), F.lit(TOKEN), F.lit(0))
    code = F.filter(found, lambda t: ~t.rlike(NOTHING))
    literal = lambda t: t.startswith("'") | t.startswith("$$")
    return F.transform(code, lambda t: F.when(literal(t), F.lit("'")).otherwise(t))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is formed once."""
    return F.transform(F.array(value), body)[0]


def _step(state: Column, t: Column) -> Column:
    """The state after a token.

    ``stack`` has two letters for each open bracket, the last for the innermost. The first says what it begins with: q a
    query, f arguments, o other, 0 and 1 nothing so far (1 where arguments are expected). The second is the mode: T before
    a table, A after one, W before the name of a common table expression, w after it, ? at the start of a bracket in
    a list of tables, else -. FROM opens a list of tables only in a query, so not in ``extract(year from x)``.
    """
    stack = state["stack"]
    head, mode = F.substring(stack, -2, 1), F.substring(stack, -1, 1)
    own = (
        F.when(head == "0", F.when(t.isin("select", "with", "from", "(", "delete"), "q").otherwise("o"))
        .when(head == "1", F.when(t.isin("select", "with", "values"), "q").otherwise("f"))
        .otherwise(head)
    )
    settled = F.when(mode == "?", F.when(t.isin("select", "with", "values", "from"), "-").otherwise("T")).otherwise(mode)

    def after(known: Column) -> Column:
        now, kind = known["mode"], known["head"]
        clause = (t == "from") & (kind == "q")
        before_table = now == "T"
        new = (
            F.when(clause, "T")
            .when((head == "0") & (t == "with"), "W")
            .when(before_table, F.when(t.isin("lateral", ",", ")"), "T").otherwise("A"))
            .when(now == "A", F.when(t.isin(",", "join"), "T").when(t.isin(*AFTER_TABLES), "-").otherwise("A"))
            .when(now == "W", F.when(t == "recursive", "W").otherwise("w"))
            .when(now == "w", F.when(t == ",", "W").when(t.isin("select", "values", *WRITES), "-").otherwise("w"))
            .otherwise(now)
        )
        opens, below = t.endswith("("), F.substring(stack, F.lit(1), F.length(stack) - 2)
        level = F.when(t == "(", F.when(before_table, "0?").otherwise("0-")).when(opens, "1-").otherwise("")
        closes = (t == ")") & (F.length(stack) > 2)
        named = before_table & ~opens & ~t.isin("lateral", "from", ",", ")", "'")
        local = (now == "W") & (t != "recursive")
        return F.struct(
            F.when(closes, below).otherwise(F.concat(below, kind, new, level)).alias("stack"),
            F.when(named, F.concat(state["tables"], t, F.lit("\n")))
            .when(before_table & (t == "'"), F.concat(state["tables"], F.lit("'\n"))).otherwise(state["tables"]).alias("tables"),
            F.when(local, F.concat(state["locals"], F.rtrim(F.rtrim(t, F.lit("("))), F.lit("\n"))).otherwise(state["locals"]).alias("locals"),
            (state["has_from"] | clause).alias("has_from"),
            (state["writes"] | ((now == "w") & (F.length(stack) == 2) & t.isin(*WRITES))).alias("writes"),
        )

    return _let(F.struct(settled.alias("mode"), own.alias("head")), after)


def _last_names(lines: Column) -> Column:
    """The last part of each dotted name, without its quotes."""
    listed = F.filter(F.split(lines, "\n"), lambda x: x != "")
    last = F.transform(listed, lambda x: F.regexp_extract(x, rf"({NAME}|')\s*$", 1))

    def bare(x: Column) -> Column:
        inner = F.substring(x, F.lit(2), F.length(x) - 2)
        return F.when(x.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).when(x.startswith("`"), inner).otherwise(x)

    return F.transform(last, bare)


def read_state(sql: Column) -> Column:
    """A struct of what a text does: ``starts`` (its first word), ``tables`` it names after FROM and JOIN without those
    it defines (``locals``), ``has_from``, ``goes_on`` behind a closing semicolon, and ``writes`` behind WITH."""
    start = F.struct(
        F.lit("0-").alias("stack"), F.lit("").alias("tables"), F.lit("").alias("locals"),
        F.lit(False).alias("has_from"), F.lit(False).alias("writes"),
    )

    def summary(listed: Column) -> Column:
        def telling(t: Column, i: Column) -> Column:
            before = F.get(listed, i - 1)
            return (i == 0) | t.isin(*KEPT) | t.endswith("(") | before.isin(*BEFORE_NAMES)

        def finished(state: Column) -> Column:
            local = _last_names(state["locals"])
            end = F.array_position(listed, ";").cast("int")
            return F.struct(
                F.coalesce(F.get(F.filter(listed, lambda t: t != "("), F.lit(0)), F.lit("")).alias("starts"),
                F.array_except(_last_names(state["tables"]), local).alias("tables"),
                local.alias("locals"), state["has_from"].alias("has_from"),
                ((end > 0) & F.exists(F.slice(listed, F.greatest(end, F.lit(1)), F.size(listed)), lambda t: t != ";")).alias("goes_on"),
                state["writes"].alias("writes"),
            )

        return _let(F.aggregate(F.filter(listed, telling), start, _step), finished)

    return _let(tokens(sql), summary)
