"""Resampling by vectors: a task folds what it sees into one array of sums over all replicates, and arrays are added.

There is no row for a replicate and a cluster. Random numbers are those of ``functions.draws``, so results do not
depend on how the work is split, and SQL can repeat them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Clusters that may be sent to every task, 24 bytes each.
SENT = 4_000_000
REPLICATES, DRAWS = 2000, 4096  # of a unit of work
FIELDS = "part string, first int, unit long, s array<double>, n array<double>"
SCHEMA = pa.schema([("part", pa.string()), ("first", pa.int32()), ("unit", pa.int64()), ("s", pa.list_(pa.float64())), ("n", pa.list_(pa.float64()))])


def tickets(prefix: str, numbers: Iterator | range) -> np.ndarray:
    """``draws.ticket`` of the prefix followed by each of the numbers."""
    digests = b"".join([md5(f"{prefix}|{j}".encode()).digest() for j in numbers])
    return np.frombuffer(digests, ">u4")[::4].astype(np.int64) if digests else np.zeros(0, np.int64)


def held(clusters: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """``s`` and ``n`` of all clusters in their order, or None where there are too many to send them around."""
    if clusters.limit(SENT + 1).count() > SENT:
        return None
    rows = clusters.orderBy("cluster").select("s", "n").toPandas()
    return rows["s"].to_numpy(float), rows["n"].to_numpy(float)


def added(parts: DataFrame, boot: int) -> DataFrame:
    """(part, b, s, n): arrays of the same part and replicates added up, in the order of their units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, s, n = None, None, None

        def shown() -> pa.RecordBatch:
            size = len(s)
            return pa.record_batch(
                [pa.array([key[0]] * size, pa.string()), pa.array(np.arange(key[1], key[1] + size)), pa.array(s), pa.array(n)],
                names=["part", "b", "s", "n"],
            )

        for batch in batches:
            for part, first, _, more_s, more_n in zip(*[c.to_pylist() for c in batch.columns]):
                if (part, first) != key:
                    if key is not None:
                        yield shown()
                    key, s, n = (part, first), np.zeros(len(more_s)), np.zeros(len(more_n))
                s += more_s
                n += more_n
        if key is not None:
            yield shown()

    dealt = parts.repartition("part", "first").sortWithinPartitions("part", "first", "unit")
    return dealt.mapInArrow(run, "part string, b long, s double, n double")


def folded_draws(spark: SparkSession, count: int, boot: int, fold: Callable[[int, range], tuple[float, float]]) -> DataFrame:
    """(part, b, s, n): the sums of ``fold(b, numbers)`` over the numbers below ``count``, in units of a bounded size."""
    chunks, blocks = -(-boot // REPLICATES), max(1, -(-count // DRAWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                chunk, block = divmod(unit, blocks)
                numbers = range(block * DRAWS, min(count, (block + 1) * DRAWS))
                replicates = range(chunk * REPLICATES, min(boot, (chunk + 1) * REPLICATES))
                s, n = zip(*[fold(b, numbers) for b in replicates])
                yield pa.record_batch([["all"], [replicates.start], [unit], [list(s)], [list(n)]], schema=SCHEMA)

    units = chunks * blocks
    return added(spark.range(0, units, 1, min(units, 4096)).mapInArrow(run, FIELDS), boot)


def drawn_clusters(spark: SparkSession, table: tuple[np.ndarray, np.ndarray], boot: int, salt: int) -> DataFrame:
    """(b, s, n): sums over as many clusters, drawn with replacement, as there are."""
    sent, k = spark.sparkContext.broadcast(table), len(table[0])

    def fold(b: int, numbers: range) -> tuple[float, float]:
        ix = tickets(f"{salt}|{b}", numbers) % k
        return sent.value[0][ix].sum(), sent.value[1][ix].sum()

    return folded_draws(spark, k, boot, fold).drop("part")


def flipped_clusters(spark: SparkSession, table: tuple[np.ndarray, np.ndarray], boot: int, salt: int) -> DataFrame:
    """(b, s, n): sums over all clusters with a random sign each."""
    sent, k = spark.sparkContext.broadcast(table), len(table[0])

    def fold(b: int, numbers: range) -> tuple[float, float]:
        up = tickets(f"{salt}|flip|{b}", numbers) % 2 == 1
        s = sent.value[0][numbers.start:numbers.stop]
        return np.where(up, s, -s).sum(), float(len(numbers))

    return folded_draws(spark, k, boot, fold).drop("part")


# attempts as units


def binomial_steps(n: int, p: float) -> np.ndarray:
    """The cumulative probabilities of 0, 1, ..., n - 1 of n; a uniform number draws as many as it reaches."""
    if p <= 0 or p >= 1:
        return np.full(n, 1.0 if p <= 0 else 0.0)
    ways = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in range(n)]
    return np.cumsum([exp(w + i * log(p) + (n - i) * log1p(-p)) for i, w in enumerate(ways)])


def _poisson_steps() -> np.ndarray:
    """The same for a count with mean 1, up to 12; the rest is below 1e-10."""
    steps, term = [], np.exp(-1.0)
    for i in range(12):
        steps.append((steps[-1] if steps else 0.0) + term)
        term /= i + 1
    return np.array(steps)


COPIES = _poisson_steps()
UNIFORM = float(1 << 32)


def resampled_attempts(rates: DataFrame, boot: int, salt: int, seeds: list[tuple[int, int]]) -> DataFrame:
    """(part, b, s, n): summed differences and tasks of two-stage replicates, a part for each pair of ``seeds``.

    ``rates`` has a row for each task: cluster, task and the pass rates ``pb``, ``pt``. A replicate holds each cluster as
    often as a Poisson draw with mean 1 says, which is how often draws with replacement hit it where clusters are many; in
    each copy, treat and base attempt a task as often as the pair says, and a binomial draw on its rate says how often
    they pass. Tasks may be split anyhow, also those of one cluster.
    """
    cache: dict[tuple[int, float], np.ndarray] = {}

    def steps(n: int, p: float) -> np.ndarray:
        if (n, p) not in cache:
            cache[n, p] = binomial_steps(n, p)
        return cache[n, p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        copies: dict[int, np.ndarray] = {}
        unit = None
        for batch in batches:
            for cluster, task, pb, pt in zip(*[c.to_pylist() for c in batch.columns]):
                unit = task if unit is None else unit
                if cluster not in copies:
                    if len(copies) > 1000:
                        copies.clear()
                    u = tickets(f"{salt}|copies|{cluster}", range(boot)) / UNIFORM
                    copies[cluster] = np.searchsorted(COPIES, u, side="right")
                times = copies[cluster]
                for treat, base in seeds:
                    s, n = sums.setdefault(f"{treat} x {base}", (np.zeros(boot), np.zeros(boot)))
                    n += times
                    for r in range(times.max(initial=0)):
                        some = np.flatnonzero(times > r)
                        for sign, arm, size, p in ((1, "treat", treat, pt), (-1, "base", base, pb)):
                            u = tickets(f"{salt}|{arm}|{size}|{task}|{r}", some) / UNIFORM
                            s[some] += sign * np.searchsorted(steps(size, p), u, side="right") / size
        for part, (s, n) in sums.items():
            for first in range(0, boot, REPLICATES):
                stop = first + REPLICATES
                yield pa.record_batch([[part], [first], [unit], [s[first:stop].tolist()], [n[first:stop].tolist()]], schema=SCHEMA)

    tasks = rates.selectExpr("cluster", "CAST(task AS BIGINT) AS task", "pb", "pt").repartition("task")
    return added(tasks.mapInArrow(run, FIELDS), boot)
