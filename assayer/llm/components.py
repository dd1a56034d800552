"""Connected components of a graph given as edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import stored


def _through(df: DataFrame, column: str, hook: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by its parent where it has one."""
    parents = hook.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    joined = df.join(parents, F.col(column) == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_parent", column)).select(df.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): equal labels if and only if connected.

    Each round, every class hooks onto its smallest neighbour and pointers are shortened once; classes that met carry
    one name from then on and edges inside a class vanish, so the graph shrinks by a factor each round. Both sides of
    every join are stored tables, which lets Spark split a class that holds a large share of all nodes. Loops and
    repeated edges are harmless; null ends are ignored; no edges give no rows.
    """
    links = stored(edges.select("a", "b").where("a <> b").distinct(), "links")
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = ends.select("node", F.col("node").alias("label"))
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("parent")).union(links.select("b", "a"))
        least = both.groupBy("node").agg(F.min("parent").alias("parent"))
        hook = stored(least.where("parent < node"), "hooks")
        hook = stored(_through(hook, "parent", hook), "hooks")
        labels = stored(_through(labels, "label", hook), "labels")
        links = stored(_through(_through(links, "a", hook), "b", hook).where("a <> b").distinct(), "links")
    return labels
