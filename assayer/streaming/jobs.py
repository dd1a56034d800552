"""Streaming forms of the metrics, sessions and resting, on file streams.

Each function takes a streaming frame and returns one. ``run_available`` processes what is there, writes every
batch to the shared folder and can be called again on the same folder to go on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import groups as grp
from assayer.session import fresh_path, settle

c = F.col
COUNTS = "read BIGINT, late BIGINT"


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """The files in the folder ``path``, or under all that it matches; the oldest first where a batch is bounded."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).load(path)


def run_available(stream: DataFrame, mode: str, folder: str | None = None) -> str:
    """Process all input there is; batches land under ``folder`` with their number in ``batch``.

    A batch is written in overwrite mode under its own number, so one that is replayed after a lost executor
    or a restart replaces itself. So do the counts of each batch beside it, see ``row_counts``.
    """
    spark = stream.sparkSession
    folder = folder or fresh_path(spark, "stream")
    # so that there is a table also where no batch has come yet
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")
    spark.createDataFrame([], COUNTS).write.mode("overwrite").parquet(f"{folder}/counts/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    counts = {p["batchId"]: _counted(p) for p in query.recentProgress}
    for number, (read, late) in counts.items():
        spark.createDataFrame([(read, late)], COUNTS).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
    return folder


def _counted(progress) -> tuple[int, int]:
    """Rows that a batch read, and rows that stateful steps dropped because they lay behind the watermark."""
    return progress["numInputRows"], sum(s["numRowsDroppedByWatermark"] for s in progress["stateOperators"])


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, read, late) of the batches under ``folder``, of the last hundred of each run.

    Rows that are aggregated before the shuffle count as late once for each group they form there.
    """
    return spark.read.schema(f"{COUNTS}, batch INT").parquet(f"{folder}/counts")


def written(spark: SparkSession, folder: str, schema: DataFrame) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    return spark.read.schema(f"{fields}, batch INT").parquet(f"{folder}/out")


def appended(stream: DataFrame) -> DataFrame:
    """Rows of an append-mode stream."""
    folder = run_available(stream, "append")
    return written(stream.sparkSession, folder, stream).drop("batch")


def latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last row written per key by an update-mode stream."""
    folder = run_available(stream, "update")
    rows = written(stream.sparkSession, folder, stream)
    rest = [x for x in stream.columns if x not in keys]
    last = F.max_by(F.struct(*rest), "batch")
    return rows.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*")


# ---------------------------------------------------------------- the streams


def timed(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events with a watermark; their wall-clock time is read as UTC."""
    return events.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", delay)


def window_counts(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Events and value by type per window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.groupBy(w.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(c("w.start").alias("start"), "event_type", "n", "value")
    )


def session_counts(events: DataFrame, gap: str) -> DataFrame:
    """Closed sessions per user. With partial merging each map task sends one row per user and session."""
    return (
        events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("user_id", c("w.start").alias("started_at"), c("w.end").alias("closes_at"), "n")
    )


def episode_counts(episodes: DataFrame, *keys: str) -> DataFrame:
    """Running attempts and passes."""
    return episodes.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("passed").alias("passes"))


def resent_once(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """A row sent again within the watermark counts once."""
    stamped = rows.withColumn(time, c(time).cast("timestamp")).withWatermark(time, delay)
    return stamped.dropDuplicatesWithinWatermark(keys)


def regression_alarms(scores: DataFrame, base: DataFrame, keys: list[str], from_step: int, drop: float) -> DataFrame:
    """Step rows joined with the accuracy of step 0 as they arrive; the first step that fell is kept per key."""
    fell = scores.where(c("step") >= from_step).join(base, keys).where(c("acc") < c("base_acc") - drop)
    first = F.min(F.struct("step", "acc", "base_acc"))
    return fell.groupBy(*keys).agg(first.alias("f")).select(*keys, "f.*")


REST_OUT = "task BIGINT, step INT, flat BOOLEAN, streak INT"


def rest_streaks(groups: DataFrame) -> DataFrame:
    """Consecutive flat groups per task, carried in keyed state from batch to batch."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Streak(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.streak = handle.getValueState("streak", "n INT")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            # one row per step of a task: the rows of a key are bounded by the number of steps
            steps = pd.concat(list(rows)).sort_values("step")
            n = self.streak.get()[0] if self.streak.exists() else 0
            streaks = []
            for flat in steps["flat"]:
                n = n + 1 if flat else 0
                streaks.append(n)
            self.streak.update((n,))
            yield pd.DataFrame({"task": key[0], "step": steps["step"], "flat": steps["flat"], "streak": streaks})

        def close(self) -> None:
            pass

    return groups.groupBy("task").transformWithStateInPandas(
        statefulProcessor=Streak(), outputStructType=REST_OUT, outputMode="append", timeMode="none"
    )


# ---------------------------------------------------------------- the resting pool

STATE, PENDING = "task BIGINT, streak INT, rested_at INT", "task BIGINT, step INT, flat BOOLEAN"


class RestPool:
    """``groups.rest_pool`` on a stream of (task, step, flat) whose steps arrive in order, cut anywhere.

    ``tasks`` is the pool. Each batch reads the last version of the state before it and writes its own in overwrite mode, so
    a batch that is replayed replaces itself. Groups of the newest step wait, since more of it may come; ``finish``
    takes them too. A version has the state of all tasks, the waiting groups, the rests that ended, and where to go on.
    """

    def __init__(self, tasks: DataFrame, folder: str, drop_after: int = 2, readmit_after: int = 25, needed: int = 8):
        self.spark, self.tasks, self.folder = tasks.sparkSession, tasks.select("task").distinct(), folder
        self.rules, self.pool = (drop_after, readmit_after, needed), self.tasks.count()

    def _path(self, table: str, version: int | None = None) -> str:
        return f"{self.folder}/{table}" + ("" if version is None else f"/version={version}")

    def _read(self, table: str, fields: str, version: int) -> DataFrame:
        return self.spark.read.schema(fields).parquet(self._path(table, version))

    def _versions(self) -> list[tuple[int, int]]:
        """(version, next step) of all versions whose last table is written."""
        jvm, path = self.spark._jvm, self._path("next")
        found = jvm.org.apache.hadoop.fs.Path(path)
        if not found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found):
            return []
        rows = self.spark.read.schema("next INT, version INT").parquet(path).collect()  # one for each batch
        return sorted((r.version, r.next) for r in rows)

    def take(self, batch: DataFrame, number: int, last: bool = False) -> None:
        """Advance by the groups of a batch; what later versions say is not looked at."""
        before = [v for v in self._versions() if v[0] < number]
        waiting = batch.select("task", "step", "flat")
        if before:
            version, start = before[-1]
            state = self._read("state", STATE, version)
            waiting = waiting.unionByName(self._read("pending", PENDING, version))
        else:
            state, start = grp.fresh_state(self.tasks), None
        waiting = settle(waiting)
        low, high = waiting.agg(F.min("step"), F.max("step")).first()
        start, ended = low if start is None else start, []
        if high is not None:
            end = high + 1 if last else high
            if start is not None and end > start:
                ready = waiting.where(c("step") < end)
                state, _ = grp.advance(ready, state, start, end, self.pool, ended.append, *self.rules)
                start, waiting = end, waiting.where(c("step") >= end)
        none = self.spark.createDataFrame([], f"task BIGINT, {grp.RESTS}")
        rests = reduce(DataFrame.unionByName, ended, none)
        for table, rows in (("rests", rests), ("pending", waiting), ("state", state)):
            rows.write.mode("overwrite").parquet(self._path(table, number))
        self.spark.createDataFrame([(start,)], "next INT").write.mode("overwrite").parquet(self._path("next", number))

    def run_available(self, stream: DataFrame) -> None:
        """Process all input there is, from where the last run ended."""
        stream.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(self.take).trigger(
            availableNow=True
        ).start().awaitTermination()

    def finish(self) -> DataFrame:
        """(task, rested, back) of all rests, those that go on with the step at which they are due."""
        versions = [v for v, _ in self._versions()]
        number = versions[-1] + 1 if versions else 0
        self.take(self.spark.createDataFrame([], PENDING), number, last=True)
        done = self.spark.read.schema(f"task BIGINT, {grp.RESTS}").parquet(*[self._path("rests", v) for v in [*versions, number]])
        return done.unionByName(grp.open_rests(self._read("state", STATE, number), self.rules[1]))
