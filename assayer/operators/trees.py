"""Roll-up along a ``parent`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import settle


def top_ancestors(nodes: DataFrame, keys: list[str], is_top: str) -> DataFrame:
    """For every node, the nearest node at or above it for which ``is_top`` holds.

    ``nodes`` has ``keys``, ``id``, ``parent_id`` and a boolean ``is_top``. Each round doubles the stretch a
    pointer spans, so a tree of depth d takes about log2(d) joins on the id; finished nodes leave the join.
    Nodes under no top are left out. A round that brings no node further ends the loop, so a cycle
    cannot keep it going.
    """
    step = F.when(F.col(is_top), F.col("id")).otherwise(F.col("parent_id"))
    hops = settle(nodes.select(*keys, "id", step.alias("at"), F.col(is_top).alias("done")))
    open_before = None
    while True:
        todo = hops.where(~F.col("done") & F.col("at").isNotNull())
        open_now = todo.count()
        if open_now == 0 or open_now == open_before:
            break
        open_before = open_now
        onward = hops.select(*keys, F.col("id").alias("at"), F.col("at").alias("next"), F.col("done").alias("next_done"))
        moved = todo.drop("done").join(onward, [*keys, "at"], "left").select(
            *keys, "id", F.col("next").alias("at"), F.coalesce("next_done", F.lit(False)).alias("done")
        )
        hops = settle(hops.where(F.col("done")).unionByName(moved))
    return hops.where(F.col("done")).select(*keys, "id", F.col("at").alias("top_id"))
