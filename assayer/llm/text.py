"""Column expressions and small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import session
from assayer.session import fresh_path

SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLDS = 5


def configure(spark: SparkSession) -> SparkSession:
    """The settings of the library, with batches of few rows from the reader, since texts can be long."""
    session.configure(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    return spark


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept; texts of ASCII alone take the faster function."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def words(text: Column) -> Column:
    """The runs of anything but space, tab and line breaks; an empty array for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn from: crc32 of the id's decimal text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
