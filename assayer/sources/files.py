"""Readers of episode logs, task files, gold tables, benchmark items and reference documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.compare import shapes_of
from assayer.operators.ranking import number_rows

c = F.col

EPISODE = (
    "arm STRING, task STRING, schema STRING, hops INT, seed INT, pass BOOLEAN, gate STRING, sql STRING, via STRING,"
    " turns INT, n_run_sql INT, hit_cap BOOLEAN, final_text STRING, secs DOUBLE, eval_step INT, `set` STRING,"
    " submitted BOOLEAN, overflow BOOLEAN"
)
TASK = (
    "id STRING, schema STRING, kind STRING, match STRING, hops INT, q STRING, ddl STRING, gold ARRAY<STRING>,"
    " gold_sql STRING, condition_cols ARRAY<ARRAY<INT>>, ignore_order BOOLEAN, difficulty STRING, proxy_score INT,"
    " p_hat DOUBLE, `set` STRING, external_knowledge STRING"
)
ITEM = "instance_id STRING, db STRING, question STRING, external_knowledge STRING"
EVAL = "instance_id STRING, condition_cols ARRAY<ARRAY<INT>>, ignore_order BOOLEAN"
EVIDENCE = "question_id BIGINT, db_id STRING, question STRING, evidence STRING, difficulty STRING, `SQL` STRING"

# fixed values: how a document and a hint follow a question, and the hops of a difficulty
DOCUMENT_NOTE = "\n\nReference document (%s):\n%s"
EVIDENCE_NOTE = "\n\nEvidence: %s"
HOPS = {"simple": 1, "moderate": 2, "challenging": 3}


def read_episodes(spark: SparkSession, paths: list[str], schema: str = EPISODE) -> DataFrame:
    """Any number of JSON-lines logs as one frame; blank lines are skipped, a broken line is kept in
    ``_corrupt_record`` with all other columns missing."""
    return spark.read.schema(f"{schema}, _corrupt_record STRING").option("mode", "PERMISSIVE").json(paths)


def read_tasks(spark: SparkSession, path: str, schema: str = TASK) -> DataFrame:
    """JSON arrays of tasks; an array is one document, so a file is one task's work and many files spread."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def gold_files(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """``(task, gold_ix, file)``: ``{id}`` and every ``{id}_x`` are the golds 0, 1, ... of task ``id``, its own file first.

    ``tasks`` lists the ids, for a name alone does not tell a suffix from an id that has a ``_`` itself.
    """
    parts = F.split("file", "_")
    starts = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_")
    )
    named = files.select("file", F.explode(starts).alias("task")).join(tasks.select("task").distinct(), "task")
    order = F.struct((c("file") != c("task")).alias("further"), F.concat("file", F.lit(".csv")).alias("name"), "file")
    listed = named.groupBy("task").agg(F.array_sort(F.collect_list(order)).alias("fs"))  # the golds of one task
    return listed.select("task", F.posexplode("fs").alias("gold_ix", "f")).select("task", "gold_ix", "f.file")


def read_gold_csv(
    spark: SparkSession, path: str, tasks: DataFrame, name: str = r"([^/]+)\.csv$"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold tables as ``(cells, shapes, column names)`` of the listed ``tasks``.

    The first row of a file is its header; all cells are text and empty text stays empty. ``name`` finds the file's
    name in its path. Files may have any width: the widest header sets how many fields are read, and a row with
    more fields than that is an error. A file is read by one task, so its lines keep their order.
    """
    lines = spark.read.text(path).select(
        c("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"),
        (F.regexp_count("value", F.lit(",")) + 1).alias("fields"),
    )
    widest = lines.groupBy("file").agg(F.min_by("fields", "line").alias("fields")).agg(F.max("fields")).first()[0] or 1
    columns = [f"_c{i}" for i in range(widest)]
    raw = (
        spark.read.schema(", ".join(f"{x} STRING" for x in [*columns, "_more"]))
        .option("header", False)
        .option("multiLine", True)
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .option("escape", '"')
        .csv(path)
        .select(
            F.regexp_extract("_metadata.file_path", name, 1).alias("file"),
            F.monotonically_increasing_id().alias("line"),
            F.when(c("_more").isNull(), F.array(*columns)).otherwise(
                F.raise_error(F.lit("a row of a gold table is wider than every header"))
            ).alias("values"),
        )
    )
    lines = number_rows(raw, ["file"], ["line"], "row_no")
    named = lines.join(gold_files(lines.select("file").distinct(), tasks), "file")
    keys = ["task", "gold_ix"]
    # the header fixes the width; inside it an empty field is empty text
    header = (
        named.where(c("row_no") == 1)
        .select(*keys, F.posexplode("values").alias("col_ix", "name"))
        .where(c("name").isNotNull())
    )
    widths = header.groupBy(*keys).agg((F.max("col_ix") + 1).alias("n_cols"))
    body = named.where(c("row_no") > 1).join(widths, keys)
    cells = body.select(
        *keys, (c("row_no") - 2).alias("row_ix"), F.posexplode(F.slice("values", F.lit(1), c("n_cols"))).alias("col_ix", "val")
    ).withColumns({"val": F.coalesce("val", F.lit("")), "kind": F.lit("str")})
    heights = shapes_of(cells, keys).select(*keys, "n_rows")
    shapes = widths.join(heights, keys, "left").fillna(0, ["n_rows"])
    return cells, shapes, header


def benchmark_items(items: DataFrame, options: DataFrame, prefix: str = "local") -> DataFrame:
    """Items whose id starts with ``prefix``, with their evaluation options; no options means ordered, all columns."""
    kept = items.where(c("instance_id").startswith(prefix))
    joined = kept.join(options, "instance_id", "left")
    none = F.array().cast("array<array<int>>")
    return joined.withColumns(
        {
            "condition_cols": F.coalesce("condition_cols", none),
            "ignore_order": F.coalesce("ignore_order", F.lit(False)),
        }
    )


def read_documents(spark: SparkSession, path: str, name: str = r"([^/]+)$") -> DataFrame:
    """Whole text files with their names."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", name, 1).alias("external_knowledge"), c("value").alias("document")
    )


def attach_documents(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Append the named document to the question when there is one."""
    note = F.format_string(DOCUMENT_NOTE, "external_knowledge", "document")
    q = F.concat("question", F.when(F.length("document") > 0, note).otherwise(""))
    return items.join(documents, "external_knowledge", "left").withColumn("q", q).drop("document")


def evidence_items(items: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tasks, rejected)``. ``catalog`` lists databases, and per item whether its gold failed is in ``gold_error``.

    Items without a database or with a failing gold are rejected with the reason.
    """
    known = items.join(catalog.select("db_id", F.lit(True).alias("known")), "db_id", "left")
    reason: Column = F.when(c("known").isNull(), "no database").when(c("gold_error").isNotNull(), c("gold_error"))
    judged = known.withColumn("reason", reason).drop("known")
    levels = F.create_map(*[F.lit(x) for pair in HOPS.items() for x in pair])
    hint = F.when(F.length("evidence") > 0, F.format_string(EVIDENCE_NOTE, "evidence")).otherwise("")
    tasks = judged.where(c("reason").isNull()).withColumns(
        {
            "hops": F.coalesce(F.try_element_at(levels, c("difficulty")), F.lit(0)),
            "q": F.concat("question", hint),
            "ignore_order": F.lit(True),
        }
    )
    return tasks.drop("reason"), judged.where(c("reason").isNotNull()).select("question_id", "db_id", "reason")
