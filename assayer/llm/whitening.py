"""Whitening of embeddings: scatter and projection as products of MLlib's distributed block matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.centroids import on_grid, usable
from assayer.llm.text import stored

BLOCK_VALUES = 1 << 17  # values of a block, about 1 MB
BLOCKS_A_TASK = 16  # blocks that one task of the scatter multiplies
#: Blocks of one projection: MLlib deals n rows of blocks to about the root of n tasks, so a task sees at most 64.
BLOCKS_A_PRODUCT = 4096


def _blocks(rows_a_block: int, size: int, centre: np.ndarray):
    """Rows (block, values): centred rows at their places in the block, in columns; places of other rows are zero.

    Rows come in the order of their numbers, but a file may be split within a block. Its parts are added up by both
    products, since rows of zeros add nothing.
    """
    schema = pa.schema([("block", pa.int64()), ("data", pa.binary())])

    def flushed(block: int, held: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([block], pa.int64()), pa.array([held.tobytes(order="F")], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - centre
            of = row // rows_a_block
            for cut in np.split(np.arange(len(row)), np.flatnonzero(np.diff(of)) + 1):
                if of[cut[0]] != block:
                    if held is not None:
                        yield flushed(block, held)
                    block, held = int(of[cut[0]]), np.zeros((rows_a_block, size), order="F")
                held[row[cut] % rows_a_block] = x[cut]
        if held is not None:
            yield flushed(block, held)

    return run


def _block_matrix(blocks: DataFrame, shape: tuple[int, int], rows: int) -> BlockMatrix:
    """A matrix of one column of blocks from rows (block, data)."""
    height, width = shape

    def dense(r):
        return (int(r.block), 0), DenseMatrix(height, width, np.frombuffer(r.data, np.float64))

    return BlockMatrix(blocks.rdd.map(dense), height, width, rows, width)


def _times(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a b, with the inner dimension in ``splits`` parts that are multiplied apart and then added."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def _numbered(vectors: DataFrame) -> DataFrame:
    """``vectors`` with numbers ``row`` from 0 without gaps, off the parts in which they are stored first."""
    ident = F.monotonically_increasing_id()
    placed = stored(vectors.select("x", F.shiftrightunsigned(ident, 33).alias("part"), ident.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "fit")
    starts, total = [], 0
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each task
        starts.append((r.part, total))
        total += r.n
    table = vectors.sparkSession.createDataFrame(starts, "part long, start long")
    numbered = placed.join(F.broadcast(table), "part")
    return numbered.select((F.col("start") + F.col("place")).alias("row"), "x")


def _projected(spark: SparkSession, blocks: DataFrame, n: int, height: int, size: int, whitener: np.ndarray) -> DataFrame:
    """(row, whitened) by block products with the whitening matrix, of a bounded number of blocks each."""
    count = -(-n // height)
    wide = whitener.shape[1]
    out = None

    def unfolded(block):
        (i, _), matrix = block
        values = matrix.toArray()
        return [(i * height + at, values[at].tolist()) for at in range(min(height, n - i * height))]

    for first in range(0, count, BLOCKS_A_PRODUCT):
        some = blocks.where(F.col("block").between(first, first + BLOCKS_A_PRODUCT - 1))
        # as many parts as there are blocks, most of them empty, because MLlib takes the larger count of both sides
        parts = spark.sparkContext.parallelize([((0, 0), DenseMatrix(size, wide, whitener.ravel(order="F")))], min(count, BLOCKS_A_PRODUCT))
        product = _block_matrix(some, (height, size), n).multiply(BlockMatrix(parts, size, wide, size, wide))
        rows = spark.createDataFrame(product.blocks.flatMap(unfolded), "row long, whitened array<double>")
        out = rows if out is None else out.union(rows)
    return out


def whiten(
    vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and leading component.

    Entries become whole numbers x = floor(scale * entry). The model is fitted on each distinct vector x once: n vectors
    with sums S are centred, cut into blocks of rows, and a BlockMatrix is multiplied by its transpose to the scatter;
    its eigenvectors are found on the driver (it is as wide as a vector), and a second product with the whitening
    matrix projects the rows. Components are numbered from 1 by falling eigenvalue e; ``whitened`` is the
    projection of x - S/n over sqrt(e), ``explained`` e over the trace, ``deviation`` the exact sum of (n x - S)^2, null
    where it exceeds a long, and ``identity_error`` the largest entry by which the covariance of ``whitened`` over
    the fitted vectors is off the identity.

    Rows whose vector is null or has null, NaN or infinite entries are dropped. Shorter vectors are filled with zeros to
    the longest, so an empty one is a zero vector unless all are; then no row has a component. Repeated vectors and ids
    keep a row each. Components with an eigenvalue of zero, up to rounding, have no direction: ``whitened`` is null there,
    and ``explained`` is null if the trace is zero. Extra columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    entry = F.col(vector_col)
    rows = stored(vectors.where(usable(entry)).select(F.col(id_col).alias("id"), on_grid(entry, scale).alias("x")), "rows")
    size = rows.agg(F.max(F.size("x")).alias("size")).first().size or 0
    if size == 0:
        kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, {kinds}")
    filled = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), size - F.size("x"))))
    fit = stored(_numbered(filled.select("x").distinct()), "numbered")
    sums = fit.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]).first()
    n, total = sums.n, [int(sums[f"s{i}"]) for i in range(size)]

    height = max(1, block_values // size)
    blocks = fit.mapInArrow(_blocks(height, size, np.array([s / n for s in total])), "block long, data binary")
    matrix = _block_matrix(blocks, (height, size), n)
    scatter = _times(matrix.transpose(), matrix, max(1, -(-n // height) // BLOCKS_A_TASK)).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2 * n)
    values, directions = np.linalg.eigh(covariance)
    trace, wanted = float(np.trace(covariance)), min(components, size)
    values, directions = values[::-1][:wanted], directions[:, ::-1][:, :wanted]
    real = values > 1e-12 * trace if trace > 0 else np.zeros(wanted, bool)
    whitener = directions * np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0)

    projected = stored(_projected(spark, blocks, n, height, size, whitener), "projected")
    w = [F.col("whitened")[i] for i in range(wanted)]
    pairs = [(i, j) for i in range(wanted) for j in range(i + 1) if real[i] and real[j]]
    error = None
    if pairs:
        found = projected.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{at}") for at, (i, j) in enumerate(pairs)]).first()
        error = max(abs(found[f"c{at}"] - (i == j)) for at, (i, j) in enumerate(pairs))

    exact = "decimal(38,0)"
    listed = F.array(*[F.lit(str(s)).cast(exact) for s in total])
    off = F.zip_with("x", listed, lambda x, s: x.cast(exact) * n - s)
    added = F.aggregate(off, F.lit(0).cast(exact), lambda sofar, v: (sofar + v * v).cast(exact))
    known = fit.join(projected, "row").select("x", added.try_cast("long").alias("deviation"), "whitened")
    out = filled.join(stored(known, "whitened"), "x")
    each = F.array(*[
        F.struct(
            F.lit(i + 1).alias("component"),
            (w[i] if real[i] else F.lit(None).cast("double")).alias("whitened"),
            F.lit(float(values[i] / trace) if trace > 0 else None).cast("double").alias("explained"),
        )
        for i in range(wanted)
    ])
    unfolded = out.select("id", "deviation", F.explode(each).alias("c"))
    return unfolded.select(
        F.col("id").alias(id_col), "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
