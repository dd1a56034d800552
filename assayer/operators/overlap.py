"""Tasks that share text or names with material seen elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

WORD_BREAK = r"[^\p{L}\p{N}]+"


def shingles(text: Column, width: int = 8) -> Column:
    """All distinct runs of ``width`` words of the whole text, in one pass of a look-ahead over the word starts."""
    words = F.trim(F.regexp_replace(F.lower(text), WORD_BREAK, " "))
    run = rf"(?<![^ ])(?=([^ ]+(?: [^ ]+){{{width - 1}}}))"
    return F.array_distinct(F.regexp_extract_all(words, F.lit(run), F.lit(1)))


def hashed_runs(df: DataFrame, key: str, width: int) -> DataFrame:
    """One row per distinct run of a text, as two hashes; a text without runs has one row of missing hashes."""
    runs = df.select(key, F.explode_outer(shingles(c("text"), width)).alias("run"))
    found = c("run").isNotNull()
    return runs.select(
        key, F.when(found, F.xxhash64("run")).alias("h1"), F.when(found, F.hash("run")).alias("h2")
    )


def shared_text(texts: DataFrame, key: str, seen: DataFrame, seen_key: str, width: int = 8) -> DataFrame:
    """Per text: its shingles, how many occur in any seen text, and its stratum.

    The seen side is one row per distinct shingle, so each shingle of a text meets at most one row and
    no pairs of texts are formed. Rows travel as two hashes, not as words.
    """
    known = (
        hashed_runs(seen, seen_key, width)
        .where(c("h1").isNotNull())
        .select("h1", "h2")
        .distinct()
        .withColumn("hit", F.lit(1))
    )
    counted = (
        hashed_runs(texts, key, width)
        .join(known, ["h1", "h2"], "left")
        .groupBy(key)
        .agg(F.count("h1").alias("shingles"), F.count("hit").alias("hits"))
    )
    return counted.withColumn("stratum", F.when(c("hits") > 0, "seen").otherwise("unseen"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two name sets."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))
