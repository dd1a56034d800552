"""Comparison of answer tables with gold tables, for any number of tasks, attempts and snapshots at once.

Tables of different shape are held in long form. ``gold`` cells have ``task, snapshot, gold_ix, row_ix, col_ix, kind,
val``; ``pred`` cells have ``attempt`` instead of ``gold_ix``. ``kind`` is null, num or str, and ``val`` is the
text of the value. Shapes (``n_rows, n_cols``) stand beside the cells because an empty table has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.cells import ABS_TOLERANCE, REL_TOLERANCE, cells_equal, exact_text, float_text, number_of
from assayer.operators.ranking import number_rows
from assayer.session import written

c = F.col
GOLD, PRED = ["task", "snapshot", "gold_ix"], ["task", "attempt", "snapshot"]
PAIR = ["task", "attempt", "snapshot", "gold_ix"]


ZERO = "0.0"  # the text of the number 0
NUMERIC = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")


def raw_cell(value: Column, dtype: str) -> Column:
    """``(num, txt)`` of a value of the given Spark type. Booleans count as 1 and 0, as numbers do elsewhere.

    Whole numbers and decimals bring their own text, for a double may not hold all their digits.
    """
    if dtype == "boolean":
        value, dtype = value.cast("int"), "int"
    numeric = dtype in NUMERIC or dtype.startswith("decimal")
    number = value.cast("double") if numeric else F.lit(None).cast("double")
    if dtype in ("float", "double"):
        text = F.lit(None).cast("string")
    else:
        text = exact_text(value, dtype) if numeric else value.cast("string")
    return F.struct(number.alias("num"), text.alias("txt"))


def cell_columns(raw: str) -> list[Column]:
    """``kind`` and ``val`` from an unfolded raw cell; the text form is built once per cell, after unfolding."""
    num, txt = c(f"{raw}.num"), c(f"{raw}.txt")
    kind = F.when(num.isNotNull(), "num").when(txt.isNotNull(), "str").otherwise("null")
    return [kind.alias("kind"), F.coalesce(txt, float_text(num)).alias("val")]


def to_cells(rows: DataFrame, keys: list[str], columns: list[str], row_ix: str = "row_ix") -> DataFrame:
    """Unfold the result columns of ``rows`` into cells; ``row_ix`` numbers the rows of a result from 0."""
    types = dict(rows.dtypes)
    values = F.array(*[raw_cell(c(n), types[n]) for n in columns])
    long = rows.select(*keys, c(row_ix).alias("row_ix"), F.posexplode(values).alias("col_ix", "x"))
    return long.select(*keys, "row_ix", "col_ix", *cell_columns("x"))


def shapes_of(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Row and column counts of the results that have cells."""
    return cells.groupBy(*keys).agg(
        F.count_if(c("col_ix") == 0).alias("n_rows"), (F.max("col_ix") + 1).alias("n_cols")
    )


def null_to_zero(cells: DataFrame, blank_too: bool) -> DataFrame:
    """Missing values read as the number 0, on the gold side also empty text."""
    zero = (c("kind") == "null") | (F.lit(blank_too) & (c("val") == ""))
    return cells.withColumns(
        {"val": F.when(zero, ZERO).otherwise(c("val")), "kind": F.when(zero, "num").otherwise(c("kind"))}
    )


def as_doubles(cells: DataFrame) -> DataFrame:
    """Numbers as the double they are read as, in one form; text stays text, also where it could be a number."""
    number = (c("val").try_cast("double") + 0.0).cast("string")  # the sum turns -0.0 into 0.0
    return cells.withColumn("val", F.when(c("kind") == "num", number).otherwise(c("val")))


def reading(cells: DataFrame, name: str) -> DataFrame:
    """Add the number a cell stands for; only text cells are looked at character by character."""
    number = F.when(c("kind") == "num", c("val").try_cast("double")).otherwise(number_of(c("val")))
    return cells.withColumn(name, number)


def digest(salts: tuple[int, ...], *values: Column) -> list[Column]:
    """Sums of the upper 33 bits of hashes of ``values``: the same for the same multiset of values, in any order."""
    return [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(salt), *values), 31)) for salt in salts]


# grids as (cells per unit, offset of their lines). In a fine cell all numbers are equal within the tolerance; its lines
# lie a quarter off the hundredths, in which amounts come. A coarse cell holds all equals of a number far from its lines.
FINE = ((1 / ABS_TOLERANCE, 0.25), (1 / ABS_TOLERANCE, 0.75))
COARSE = ((1.0, 0.5), (1 / 1024, 0.37))
NEAR = 1e-6  # share of a fine cell that counts as its line, far above the rounding of doubles
LARGEST = 1e13  # beyond it a double is no longer exact on the grids
SHORT = 10_000  # cells of a column that may be held in one array


def column_marks(cells: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Per column, in one pass: missing values, numbers and their sum, and digests of its values.

    ``text`` digests the text forms, ``fine`` and ``coarse`` the grid cells of numbers and the text of all else; each over
    (row, value) and, with ``any_``, over values alone. ``clear`` says that no number lies near a line of that grid.
    """
    x = c("_x")
    finite = F.when(F.abs(x) < float("inf"), x)  # NaN is greater
    aggregates = {
        "nulls": [F.count_if(c("kind") == "null")],
        "nums": [F.count(x)],
        "sum": [F.coalesce(F.sum(x), F.lit(0.0))],
        "size": [F.coalesce(F.sum(F.abs(x)), F.lit(0.0))],
        "text": digest((1, 2), c("row_ix"), c("val")),
        "any_text": digest((1, 2), c("val")),
    }
    for name, grids in (("fine", FINE), ("coarse", COARSE)):
        for i, (per_unit, offset) in enumerate(grids):
            at = finite * per_unit + offset
            part = at - F.floor(at)
            value = [F.floor(at), F.when(finite.isNull(), c("val"))]
            if name == "fine":
                clear = part.between(NEAR, 1 - NEAR)
                aggregates[f"fine{i}"] = digest((1, 2), c("row_ix"), *value)
            else:
                reach = F.greatest(F.lit(ABS_TOLERANCE), REL_TOLERANCE * F.abs(finite)) * (1 + 1e-6)
                clear = F.least(part, 1 - part) / per_unit > reach + 1e-9
                aggregates[f"coarse{i}"] = digest((1,), c("row_ix"), *value)
                aggregates[f"any_coarse{i}"] = digest((1,), *value)
            whole = F.bool_and(clear & (F.abs(finite) < LARGEST))
            aggregates[f"{name}{i}_clear"] = [F.coalesce(whole, F.lit(True))]
    columns = {
        name: (parts[0] if len(parts) == 1 else F.struct(*[p.alias(f"d{i}") for i, p in enumerate(parts)]))
        for name, parts in aggregates.items()
    }
    return reading(cells, "_x").groupBy(*keys, c("col_ix").alias(f"{prefix}_col")).agg(
        *[column.alias(f"{prefix}_{name}") for name, column in columns.items()]
    )


def may_match() -> Column:
    """A necessary condition: equal counts, and sums within the summed tolerance."""
    slack = ABS_TOLERANCE * c("g_nums") + 2 * REL_TOLERANCE * (c("g_size") + c("p_size")) + ABS_TOLERANCE
    apart = F.abs(c("g_sum") - c("p_sum"))
    return (
        (c("g_nulls") == c("p_nulls"))
        & (c("g_nums") == c("p_nums"))
        & ((apart <= slack) | apart.isNull() | F.isnan(apart) | F.isnan(slack))
    )


def settled_match() -> Column:
    """Whether two columns match, from their marks alone; NULL where only the cells can tell.

    Equal text at all places matches. So do equal fine cells, if no number lies near a line and rows are compared in
    their order; by rank a number may move past another. A match would put equals into equal coarse cells, if those of
    either side are clear, and text without any number is compared as it is; so other digests there mean no match.
    """

    def same(name: str) -> Column:
        return c(f"g_{name}") == c(f"p_{name}")

    def both(name: str) -> Column:
        return c(f"g_{name}_clear") & c(f"p_{name}_clear")

    yes = F.when(c("ignore_order"), same("any_text")).otherwise(
        same("text") | (both("fine0") & same("fine0")) | (both("fine1") & same("fine1"))
    )
    coarse = [F.when(c("ignore_order"), same(f"any_coarse{i}")).otherwise(same(f"coarse{i}")) for i in range(len(COARSE))]
    no = (c("g_nums") == 0) & (c("p_nums") == 0)
    for i, equal in enumerate(coarse):
        no = no | ((c(f"g_coarse{i}_clear") | c(f"p_coarse{i}_clear")) & ~equal)
    return F.when(yes, True).when(no, False)


def placed(cells: DataFrame, keys: list[str], some_unordered: bool) -> DataFrame:
    """Cells with the ``place`` they are compared at: the row, or, where ``ignore_order``, the rank of the text form with
    missing last."""
    wanted = [*keys, "col_ix", "place", "kind", "val"]
    in_rows = cells.where(~c("ignore_order")).withColumn("place", c("row_ix") + 1).select(*wanted)
    if some_unordered:
        loose = cells.where("ignore_order")
        ranked = number_rows(loose, [*keys, "col_ix"], [(c("kind") == "null"), c("val"), c("row_ix")], "place")
        in_rows = in_rows.unionByName(ranked.select(*wanted))
    return reading(in_rows, "num").drop("kind")


def sized_pairs(gold_shape: DataFrame, pred_shape: DataFrame, tasks: DataFrame) -> DataFrame:
    """Answers beside every gold of their task and snapshot, with the gold columns that count."""
    lists = c("condition_cols")
    chosen = F.when(
        F.size(lists) > 0, F.element_at(lists, F.least(c("gold_ix") + 1, F.size(lists)).cast("int"))
    )
    golds = (
        gold_shape.join(tasks, "task")
        .withColumn("wanted", chosen)
        .withColumn(
            "wanted",
            F.when(F.size("wanted") > 0, c("wanted")).otherwise(
                F.when(c("n_cols") > 0, F.sequence(F.lit(0), c("n_cols").cast("int") - 1)).otherwise(
                    F.array().cast("array<int>")
                )
            ),
        )
        .select(*GOLD, "ignore_order", "wanted", c("n_rows").alias("g_rows"), c("n_cols").alias("g_cols"))
    )
    answers = pred_shape.select(*PRED, c("n_rows").alias("p_rows"), c("n_cols").alias("p_cols"))
    return golds.join(answers, ["task", "snapshot"])


def column_matches(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(pair, g_col, p_col)`` for every wanted gold column and predicted column that agree at all places.

    One pass over the cells of each side marks its columns, and the marks settle most pairs. Only columns that they leave
    open are put in order and compared cell by cell. ``pairs`` are of ``sized_pairs``.
    """
    same = pairs.where((c("g_rows") == c("p_rows")) & (c("g_rows") > 0))
    marked = (
        same.select(*PAIR, "ignore_order", "g_rows", F.explode("wanted").alias("g_col"))
        .join(column_marks(gold, GOLD, "g"), [*GOLD, "g_col"])
        .join(column_marks(pred, PRED, "p"), PRED)
        .where(may_match())
        .withColumn("ok", settled_match())
    )
    columns = [*PAIR, "g_col", "p_col"]
    candidates = written(marked.select(*columns, "ignore_order", "g_rows", "ok").where("ok is null or ok"))
    decided, undecided = candidates.where("ok").select(*columns), candidates.where("ok is null")
    kinds = undecided.select((c("g_rows") <= SHORT).alias("short"), "ignore_order").distinct().collect()  # four at most
    parts = [decided]
    if any(r.short for r in kinds):
        parts.append(short_matches(gold, pred, undecided.where(c("g_rows") <= SHORT)))
    if not all(r.short for r in kinds):
        some_unordered = any(r.ignore_order and not r.short for r in kinds)
        parts.append(long_matches(gold, pred, undecided.where(c("g_rows") > SHORT), some_unordered))
    return reduce(DataFrame.unionByName, [part.select(*columns) for part in parts])


def _cells_of(cells: DataFrame, keys: list[str], column: str, pairs: DataFrame) -> DataFrame:
    """The cells of the columns that ``pairs`` name, with ``ignore_order``."""
    wanted = pairs.select(*keys, c(column).alias("col_ix"), "ignore_order").distinct()
    return cells.join(wanted, [*keys, "col_ix"])


def short_matches(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """The matching of ``pairs`` of columns of at most ``SHORT`` cells: each column is one ordered array."""

    def in_order(cells: DataFrame, keys: list[str], column: str) -> DataFrame:
        loose, read = c("ignore_order"), reading(_cells_of(cells, keys, column, pairs), "num")
        place = [F.when(loose, c("kind") == "null").alias("missing"), F.when(loose, c("val")).alias("text"), c("row_ix")]
        listed = F.array_sort(F.collect_list(F.struct(*place, "val", "num")))
        return read.groupBy(*keys, c("col_ix").alias(column)).agg(listed.alias(f"{column}_cells"))

    both = pairs.join(in_order(gold, GOLD, "g_col"), [*GOLD, "g_col"]).join(in_order(pred, PRED, "p_col"), [*PRED, "p_col"])
    equal = F.zip_with("g_col_cells", "p_col_cells", lambda g, p: cells_equal(g["val"], p["val"], g["num"], p["num"]))
    return both.where(F.forall(equal, lambda x: x))


def long_matches(gold: DataFrame, pred: DataFrame, pairs: DataFrame, some_unordered: bool) -> DataFrame:
    """The same for columns of any length: their cells get places and are joined, with the place in the key."""
    sides = [_cells_of(gold, GOLD, "g_col", pairs), _cells_of(pred, PRED, "p_col", pairs)]
    places = written(placed(sides[0].unionByName(sides[1], allowMissingColumns=True), [*PRED, "gold_ix"], some_unordered))
    g = places.where("attempt is null").select(*GOLD, c("col_ix").alias("g_col"), "place", c("val").alias("g_val"), c("num").alias("g_num"))
    p = places.where("attempt is not null").select(*PRED, c("col_ix").alias("p_col"), "place", c("val").alias("p_val"), c("num").alias("p_num"))
    columns = [*PAIR, "g_col", "p_col"]
    side_by_side = pairs.select(*columns).join(g, [*GOLD, "g_col"]).join(p, [*PRED, "p_col", "place"])
    agreed = F.bool_and(cells_equal(c("g_val"), c("p_val"), c("g_num"), c("p_num")))
    return side_by_side.groupBy(*columns).agg(agreed.alias("ok")).where("ok")


def against_each_gold(
    gold: DataFrame, pred: DataFrame, gold_shape: DataFrame, pred_shape: DataFrame, tasks: DataFrame
) -> DataFrame:
    """``ok`` and ``why`` per answer and gold: same row count, and each wanted gold column equal to some
    predicted column. Extra predicted columns are allowed and one may serve several gold columns."""
    pairs = written(sized_pairs(gold_shape, pred_shape, tasks))  # a row for each answer and gold
    found = column_matches(gold, pred, pairs).groupBy(*PAIR).agg(F.collect_set("g_col").alias("found"))
    judged = pairs.join(found, PAIR, "left")
    missing = F.array_except(c("wanted"), F.coalesce(c("found"), F.array().cast("array<int>")))
    # an empty gold equals any empty answer that has a column
    left = F.when((c("g_rows") == 0) & (c("p_rows") == 0) & (c("p_cols") > 0), F.array().cast("array<int>")).otherwise(
        missing
    )
    judged = judged.withColumn("left", left)
    sizes_differ = c("g_rows") != c("p_rows")
    rows_why = F.format_string("row count gold=%d pred=%d", c("g_rows"), c("p_rows"))
    column_why = F.format_string("gold column %d not matched by any predicted column", F.array_min("left"))
    why = F.when(sizes_differ, rows_why).when(F.size("left") > 0, column_why).otherwise("")
    return judged.select(*PAIR, "g_rows", "p_rows", (why == "").alias("ok"), why.alias("why"))


def best_gold(judged: DataFrame) -> DataFrame:
    """An answer passes with its first matching gold; otherwise the reason against the last gold stands."""
    return judged.groupBy(*PRED).agg(
        F.bool_or("ok").alias("ok"),
        F.min(F.when(c("ok"), c("gold_ix"))).alias("gold_ix"),
        F.max_by("why", "gold_ix").alias("last_why"),
    ).select(*PRED, "ok", "gold_ix", F.when(c("ok"), "").otherwise(c("last_why")).alias("why"))


def row_keys(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One 128-bit digest per row over its cells and their columns, summed up cell by cell in partial aggregates."""

    def digest(salt):
        return F.bit_xor(F.xxhash64(F.lit(salt), "col_ix", "kind", "val"))

    rows = cells.groupBy(*keys, "row_ix").agg(digest(1).alias("_a"), digest(2).alias("_b"))
    return rows.select(*keys, "row_ix", F.struct("_a", "_b").alias("row_key"))


def sums_of(*values: Column) -> list[Column]:
    """Sums of 30-bit pieces of two 64-bit hashes: the same for the same multiset of values, in any order."""
    pieces = []
    for salt in (1, 2):
        h = F.xxhash64(F.lit(salt), *values)
        for shift in (0, 30):
            pieces.append(F.sum(F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 30) - 1))).cast("string"))
    return pieces


def same_row_multiset(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact equality of the rows with their multiplicity; column order counts, row order does not.

    Missing values read as 0 and numbers as doubles; a text is never a number. Each table becomes one digest of its
    rows that does not depend on their order, so rows are never joined.
    """
    g = fingerprints(as_doubles(null_to_zero(gold, False)), GOLD).withColumnRenamed("fingerprint", "g_print")
    p = fingerprints(as_doubles(null_to_zero(pred, False)), PRED).withColumnRenamed("fingerprint", "p_print")
    sized = (c("g_rows") == c("p_rows")) & (c("g_cols") == c("p_cols"))
    joined = pairs.join(g, GOLD, "left").join(p, PRED, "left")
    empty_both = (c("g_rows") == 0) & (c("p_rows") == 0)
    same = sized & (c("g_print") == c("p_print"))
    return joined.select(*PAIR, (F.coalesce(same, F.lit(False)) | empty_both).alias("ok"))


def column_keys(cells: DataFrame, keys: list[str], unordered: DataFrame) -> DataFrame:
    """Digest sums per column: over (row, value), or over values alone where order is ignored."""
    flagged = cells.join(unordered.withColumn("loose", F.lit(True)), "task", "left")
    row = F.when(c("loose"), F.lit(0).cast("bigint")).otherwise(c("row_ix").cast("bigint"))

    return flagged.groupBy(*keys, "col_ix").agg(
        F.concat_ws("/", F.count("*").cast("string"), *sums_of(row, c("kind"), c("val"))).alias("key")
    )


def same_columns_strict(gold: DataFrame, pred: DataFrame, pairs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Same column count and a one-to-one match of equal columns, without tolerance.

    Equality is an equivalence, so such a match exists when both sides hold the same columns equally often.
    """
    unordered = tasks.where("ignore_order").select("task")

    def listed(cells, keys, name):
        columns = column_keys(cells, keys, unordered)
        return columns.groupBy(*keys).agg(F.array_sort(F.collect_list("key")).alias(name))

    joined = pairs.join(listed(gold, GOLD, "g_keys"), GOLD, "left").join(listed(pred, PRED, "p_keys"), PRED, "left")
    empty_both = (c("g_rows") == 0) & (c("p_rows") == 0) & (c("g_cols") == c("p_cols"))
    same = (c("g_rows") == c("p_rows")) & (c("g_cols") == c("p_cols")) & (c("g_keys") == c("p_keys"))
    return joined.select(*PAIR, F.coalesce(same | empty_both, F.lit(False)).alias("ok"))


RULES = ("benchmark", "file", "multiset", "strict")


def compare_tables(
    gold: DataFrame, pred: DataFrame, gold_shape: DataFrame, pred_shape: DataFrame, tasks: DataFrame, rule: str
) -> DataFrame:
    """One verdict per answer, ``ok, gold_ix, why``, under one of the ``RULES``; any gold of the task will do.

    - ``benchmark``: wanted gold columns against predicted columns, with tolerance.
    - ``file``: the same after missing predicted cells, and missing or empty gold cells, have become 0.
    - ``multiset``: the rows of the first gold with their multiplicity, missing cells as 0, without tolerance.
    - ``strict``: equal columns one to one, without tolerance; whole numbers and decimals digit by digit.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    if rule == "file":
        gold, pred = null_to_zero(gold, True), null_to_zero(pred, False)
    if rule in ("benchmark", "file"):
        return best_gold(against_each_gold(gold, pred, gold_shape, pred_shape, tasks))
    pairs = sized_pairs(gold_shape, pred_shape, tasks)
    if rule == "multiset":
        judged = same_row_multiset(gold, pred, pairs.where(c("gold_ix") == 0))
        why = "rows differ"
    else:
        judged, why = same_columns_strict(gold, pred, pairs, tasks), "columns differ"
    return best_gold(judged.withColumn("why", F.when(c("ok"), "").otherwise(why)))


def weak_golds(gold: DataFrame, gold_shape: DataFrame) -> DataFrame:
    """Golds that say little: no rows, one cell of 0, 1 or nothing, or only zeros and missing values."""
    x = number_of(c("val"))
    nothing = (c("kind") == "null") | F.coalesce(x == 0, F.lit(False))
    slight = nothing | F.coalesce(x == 1, F.lit(False))
    content = gold.groupBy(*GOLD).agg(
        F.count("*").alias("cells"), F.bool_and(nothing).alias("blank"), F.bool_and(slight).alias("slight")
    )
    return gold_shape.join(content, GOLD, "left").select(
        *GOLD,
        (c("n_rows") == 0).alias("empty"),
        F.coalesce((c("cells") == 1) & c("slight"), F.lit(False)).alias("trivial"),
        F.coalesce((c("n_rows") == 0) | c("blank"), F.lit(True)).alias("degenerate"),
    )


def fingerprints(cells: DataFrame, keys: list[str]) -> DataFrame:
    """A digest of the rows of each result that ignores their order."""
    rows = row_keys(cells, keys)
    return rows.groupBy(*keys).agg(
        F.concat_ws("/", F.count("*").cast("string"), *sums_of(c("row_key"))).alias("fingerprint")
    )
