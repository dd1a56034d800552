"""A training corpus from raw documents: five operators in a row, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import decontamination, exact_dedup, langid, mixing, simhash
from assayer.llm.text import configure, stored
from assayer.sources.tables import Tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those that are ``und``, without text or letters, go.

    A null lang teaches nothing, rows that share an id are judged apart, and an empty table stays empty.
    """
    configure(spark)
    return langid.keep_known(docs, langid.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the largest doc_id; null counts as the empty text, and rows without an id stay
    only where no row of their text has one. Of rows that repeat text and id, one stays."""
    configure(spark)
    return exact_dedup.drop_copies(docs, keep="largest")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the number of each row in a column of a new name, and that name. Stored, because rows are read twice
    and their partitions, off which numbers are read, change with the executors at hand."""
    row, taken = "row_no", {name.lower() for name in docs.columns}
    while row in taken:
        row += "_"
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _without(numbered: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """``numbered`` without the rows whose numbers ``dropped`` has. The numbers are stored first, so Spark knows their size
    when it plans the join: it moves no text where they are few, and partitions both sides where they are not."""
    return numbered.join(stored(dropped.select(row).distinct(), "dropped"), row, "left_anti").drop(row)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id and of these the first; a row without
    an id is kept only if none of its group has one."""
    configure(spark)
    numbered, row = _numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", row)
    near = simhash.near_duplicates(numbered.select(key.alias("key"), "text"), id_col="key")
    return _without(numbered, near.where("key <> component_id").select(f"key.{row}"), row)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark, whatever their doc_id."""
    numbered, row = _numbered(docs)
    benchmark = Tables(configure(spark), sf_dir).benchmark
    return _without(numbered, decontamination.contaminated(numbered.select(row, "text"), benchmark, id_col=row), row)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which the mix takes words, with ``size``, ``source_size``, ``target`` and ``taken``, each row its own.

    Columns of these names are replaced. Rows that share a doc_id or have none keep what the mix takes of each.
    """
    configure(spark)
    figures = ("size", "source_size", "target", "taken")
    numbered, row = _numbered(docs)
    mixed = mixing.mix(numbered.select(row, "doc_id", "source", "text"), row_col=row).where("taken > 0")
    own = [name for name in docs.columns if name.lower() not in figures]
    return numbered.select(row, *own).join(mixed.select(row, *figures), row).drop(row)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing to target weights", mixture),
]

#: Language models, fingerprint components and windows are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read as the next one's input."""
    docs = Tables(configure(spark), sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
