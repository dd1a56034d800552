"""Gap sessions that stay small per key, whatever share of the events one key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def slot_of(ts: str, gap_seconds: int) -> Column:
    """Events of one key in one slot are less than a gap apart, so they share a session."""
    return F.floor(micros(ts) / F.lit(gap_seconds * 1_000_000)).cast("bigint")


def session_slots(
    events: DataFrame, key: str | list[str], ts: str, gap_seconds: int, extra: list[Column] | None = None
) -> DataFrame:
    """One row per key and slot, numbered by session.

    The shuffle carries one partial row per (key, slot) and map task. The window then sees at most
    ``time range / gap`` rows of a key, not its events.
    """
    keys = [key] if isinstance(key, str) else key
    slots = events.groupBy(*keys, slot_of(ts, gap_seconds).alias("slot")).agg(
        F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count(F.lit(1)).alias("n"), *(extra or [])
    )
    by_time = Window.partitionBy(*keys).orderBy("slot")
    idle = micros("lo") - F.lag(micros("hi")).over(by_time)
    opens = F.when(idle.isNull() | (idle >= gap_seconds * 1_000_000), 1).otherwise(0)
    return slots.withColumn("opens", opens).withColumn("session_no", F.sum("opens").over(by_time)).drop("opens")


def sessions(events: DataFrame, key: str | list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Start, end and event count of every session; a new one opens after ``gap_seconds`` without events."""
    slots = session_slots(events, key, ts, gap_seconds)
    keys = [key] if isinstance(key, str) else key
    return slots.groupBy(*keys, "session_no").agg(
        F.min("lo").alias("started_at"), F.max("hi").alias("ended_at"), F.sum("n").alias("n_events")
    )
