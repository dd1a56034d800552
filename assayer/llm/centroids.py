"""Exact k-means over integer vectors; bounds that fall by geometry spare most distances.

Each vector carries an upper bound of the distance to its own centroid and a lower bound of that to all others. When
centroids move, the lower bound of a cluster's members falls by what the moved centroids can gain on any point of the
sphere that holds the cluster, which is less than the full drift of a centroid that does not move straight at it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import stored

#: Components beyond this would let a squared distance exceed a long.
LARGEST = 1 << 27
SLACK = 1e-9  # share by which bounds are widened, far above the rounding of doubles


def usable(vector: Column, size: int | None = None) -> Column:
    """The vector is there, has ``size`` components where given, and none of them is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vector.isNotNull() & ~F.coalesce(bad, F.lit(False))
    return whole if size is None else whole & (F.size(vector) == size)


def on_grid(vector: Column, scale: int) -> Column:
    """Each component as the integer floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _bounded(x: Column) -> Column:
    far = F.exists(x, lambda v: F.abs(v) >= LARGEST)
    return F.when(far, F.raise_error(F.lit(f"a component lies beyond {LARGEST} steps of the grid"))).otherwise(x)


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centres."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)), 1)
    if 4 * largest * largest * max(x.shape[1], 1) < 1 << 53:  # whole numbers that doubles hold exactly
        a, b = x.astype(float), centres.astype(float)
        out = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        return np.rint(out).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """``out[i, j]``: at most so much nearer does centroid j come, by its move, to any point of the sphere of cluster i.

    The sphere has its centre at ``old[i]`` and the given radius. Seen from the middle of the move, a point at the angle
    t to its direction gains at most drift * cos(t): the points that gain the same lie on a hyperbola with the two
    places of the centroid as foci, and the ray at angle t is steeper than its asymptote. By symmetry the plane through
    the sphere's centre and the move is enough, and there the least angle is that of the centre less that of the
    tangent to the circle.
    """
    old, new = old.astype(float), new.astype(float)
    move = new - old
    drift = np.sqrt((move * move).sum(1))
    direction = move / np.where(drift > 0, drift, 1)[:, None]
    off = old[:, None, :] - ((old + new) / 2)[None, :, :]  # from the middle of move j to the centre of sphere i
    far = np.sqrt((off * off).sum(2))
    along = (off * direction[None, :, :]).sum(2)
    outside = far > radius[:, None]
    safe = np.where(outside, far, 1)
    angle = np.arccos(np.clip(along / safe, -1, 1))
    tangent = np.arcsin(np.clip(np.where(outside, radius[:, None] / safe, 1), 0, 1))
    nearest = np.where(outside, np.maximum(0, angle - tangent), 0)
    return drift[None, :] * np.maximum(0, np.cos(nearest))


@dataclass
class Round:
    """What a round needs: the centroids and, after a move, how far bounds give way."""

    centres: np.ndarray
    rise: np.ndarray | None = None  # of the upper bound, by own cluster
    fall: np.ndarray | None = None  # of the lower bound, by own cluster


def moved(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Round:
    gap = loosening(old, new, radius)
    np.fill_diagonal(gap, 0)
    drift = np.sqrt(((new - old).astype(float) ** 2).sum(1))
    return Round(new, drift, gap.max(1))


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, this: Round):
    """(cluster, upper, lower, scanned) of each row under the round's centroids; ties go to the smaller number.

    A row whose upper bound lies below its lower bound, or below half the way from its centroid to the next, keeps its
    cluster. The bound is first made exact for the others, and rows that are still in doubt meet all centroids.
    """
    k = len(this.centres)
    scanned = np.ones(len(x), bool)
    if this.rise is not None and len(x):
        upper = (upper + this.rise[cluster]) * (1 + SLACK)
        between = np.sqrt(squares(this.centres, this.centres).astype(float))
        np.fill_diagonal(between, np.inf)
        lower = (lower - this.fall[cluster]) * (1 - SLACK) - SLACK
        sure = np.maximum(lower, between.min(1)[cluster] / 2 * (1 - SLACK))
        scanned = upper >= sure
        near = np.flatnonzero(scanned)
        own = np.zeros(len(near))
        for c in np.unique(cluster[near]):  # exact distance to the own centroid alone
            rows = cluster[near] == c
            own[rows] = np.sqrt(squares(x[near[rows]], this.centres[c:c + 1])[:, 0].astype(float))
        upper = upper.copy()
        upper[near] = own * (1 + SLACK)
        scanned[near] = upper[near] >= sure[near]
    else:
        cluster, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x))
    rows = np.flatnonzero(scanned)
    if len(rows):
        d = squares(x[rows], this.centres)
        best = d.argmin(1)
        cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
        cluster[rows], upper[rows] = best, np.sqrt(d[np.arange(len(rows)), best].astype(float)) * (1 + SLACK)
        if k > 1:
            d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
            lower[rows] = np.sqrt(d.min(1).astype(float)) * (1 - SLACK)
        else:
            lower[rows] = np.inf
    return cluster, upper, lower, scanned


STATE = "id long, x array<long>, cluster int, upper double, lower double, scanned boolean"


def _assigning(this: Round, size: int):
    schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.int64())), ("cluster", pa.int32()), ("upper", pa.float64()),
                        ("lower", pa.float64()), ("scanned", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            state = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)]
            cluster, upper, lower, scanned = assign(x, state[0].astype(np.int64), *state[1:], this)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper),
                                   pa.array(lower), pa.array(scanned)], schema=schema)

    return run


def _measuring(centres: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            cluster = batch.column(2).to_numpy(zero_copy_only=False)
            off = x - centres[cluster]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array((off * off).sum(1), pa.int64())], names=["id", "cluster", "distance"])

    return run


@dataclass
class Clustering:
    """``rows`` (id, cluster, distance), the final ``centres``, and the share of vectors that each round scanned."""

    rows: DataFrame
    centres: np.ndarray
    scanned: list[float]


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, size: int = 64, seed: str = "1",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> Clustering:
    """Lloyd's k-means in whole numbers, the result of which no order of summing changes.

    Vectors with ``size`` usable components are put on a grid of ``scale`` steps a unit, others are left out. The
    centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed:id``, or as all where there are fewer.
    After each of ``rounds`` assignments a centroid becomes the floor of its vectors' mean, and an empty one stays; a
    last assignment follows. Rows that share an id are vectors apart; a null id reads as an empty one at the start.
    Repeated vectors, ties (the smaller number) and extra columns do no harm. No usable vector gives no rows. A
    component beyond 2^27 steps is an error, since squared distances would not fit a long.

    State is written to the shared folder each round. Only centroids, sums and radii of k clusters reach the driver.
    """
    x = F.col(vector_col)
    kept = vectors.where(usable(x, size)).select(F.col(id_col).cast("long").alias("id"), _bounded(on_grid(x, scale)).alias("x"))
    none = F.lit(None)
    state = stored(
        kept.select("id", "x", F.lit(0).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(True).alias("scanned")),
        "vectors",
    )
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = state.select(drawn.alias("drawn"), "x").orderBy("drawn", "x").limit(k).collect()
    centres = np.array([r.x for r in first], np.int64).reshape(len(first), size)
    if not len(first):
        empty = state.select("id", "cluster", none.cast("long").alias("distance")).where(F.lit(False))
        return Clustering(empty, centres, [])
    this, shares = Round(centres), []
    for turn in range(rounds + 1):
        state = stored(state.mapInArrow(_assigning(this, size), STATE), "clusters")
        sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(size)] if turn < rounds else []
        found = state.groupBy("cluster").agg(
            F.count("*").alias("n"), F.max("upper").alias("radius"), F.count_if("scanned").alias("scanned"), *sums
        ).collect()
        shares.append(sum(r.scanned for r in found) / sum(r.n for r in found))
        if turn == rounds:
            break
        new, radius = this.centres.copy(), np.zeros(len(centres))
        for r in found:
            new[r.cluster] = [r[f"s{i}"] // r.n for i in range(size)]
            radius[r.cluster] = r.radius
        this = moved(this.centres, new, radius)
    measured = state.select("id", "x", "cluster").mapInArrow(_measuring(this.centres, size), "id long, cluster int, distance long")
    return Clustering(measured, this.centres, shares)


def clustered(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable vector; see ``cluster``."""
    done = cluster(vectors, id_col=id_col, **options)
    rows = stored(done.rows, "distances")
    per_cluster = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    total = sum(per_cluster.values())
    digests = [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in done.centres]
    table = rows.sparkSession.createDataFrame(
        [(i, int(per_cluster.get(i, 0)), int(total), digest) for i, digest in enumerate(digests)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    shown = rows.join(F.broadcast(table), "cluster")  # a row for each of k clusters
    return shown.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
