"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.components import components
from assayer.llm.text import ascii_lower, stored, words

BITS = 64
HALF = BITS // 2
LANES = (1 << HALF) + 1  # one counter for bit b in the low half of a long, one for bit b + 32 in the high half


def bit_counts(h: Column) -> list[Column]:
    """Aggregates that count, for all 64 bits, how many of the hashes have the bit set; two counts in each sum."""
    return [F.sum(F.shiftright(h, b).bitwiseAND(F.lit(LANES))).alias(f"bits{b}") for b in range(HALF)]


def majority(n: Column) -> Column:
    """The fingerprint from ``bit_counts``: a bit is 1 if set in over half of the ``n`` hashes."""
    bits = F.lit(0).cast("long")
    for b in range(BITS):
        pair = F.coalesce(F.col(f"bits{b % HALF}"), F.lit(0))
        count = pair.bitwiseAND(F.lit((1 << HALF) - 1)) if b < HALF else F.shiftright(pair, HALF)
        one = F.shiftleft(F.lit(1).cast("long"), b)
        bits = bits.bitwiseOR(F.when(count * 2 > n, one).otherwise(F.lit(0).cast("long")))
    return bits


def shingle(k: int) -> Column:
    """The shingle of ``k`` words that starts at ``pos`` of the array ``words``, joined by spaces."""
    return F.concat_ws(" ", *[F.expr(f"try_element_at(words, pos + {i + 1})") for i in range(k)])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long) for each row of ``docs``: the majority of XXH64 over its shingles of ``k`` words.

    Words are lower-cased in A-Z alone. Shingles count as often as they occur. A text of fewer than ``k`` words has one
    shingle, all it has; null, empty and blank texts have none and get zero. Rows that share an id stay apart.
    """
    listed = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(id_col).alias("doc_id"),
        words(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))).alias("words"),
    )
    placed = listed.select("row_no", "doc_id", "words", F.posexplode_outer("words").alias("pos", "word"))
    starts = placed.where(f"pos is null or pos = 0 or pos <= size(words) - {k}")
    h = F.when(F.col("pos").isNotNull(), F.xxhash64(shingle(k)))
    hashed = starts.select("row_no", "doc_id", h.alias("h"))
    counted = hashed.groupBy("row_no", "doc_id").agg(F.count("h").alias("n"), *bit_counts(F.col("h")))
    return counted.select(F.col("doc_id").alias(id_col), majority(F.col("n")).alias("fingerprint"))


def _ball(segments: int, radius: int) -> Column:
    """(segment, key, probe) entries of ``fingerprint``: each segment as it is, and with each of its set bits cleared.

    Two values that differ in one bit meet where the one that has the bit clears it, so half a Hamming ball of radius
    one suffices. By the pigeonhole principle, fingerprints within ``radius`` have a segment within radius // segments.
    """
    near = radius // segments
    if near > 1 or segments < 2:
        raise ValueError("take more segments: two at least, and so many that the ball within one has radius 0 or 1")
    cuts = [BITS * i // segments for i in range(segments + 1)]
    entries = []
    for s, (low, high) in enumerate(zip(cuts, cuts[1:])):
        key = F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        entries.append(F.struct(F.lit(s).alias("segment"), key.alias("key"), F.lit(0).alias("probe")))
        for b in range(high - low) if near else []:
            bit = F.lit(1 << b)
            cleared = F.struct(F.lit(s).alias("segment"), (key - bit).alias("key"), F.lit(1).alias("probe"))
            entries.append(F.when(key.bitwiseAND(bit) != 0, cleared))
    return F.array_compact(F.array(*entries))


class _Forest:
    """Union-find over the entries a bucket holds itself; probes are only passed through."""

    def __init__(self, radius: int):
        self.radius, self.homes, self.root = radius, np.empty(0, np.uint64), []

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def add(self, values: np.ndarray, probes: np.ndarray, out: list) -> None:
        """Take the next entries of the bucket, homes before probes; append the edges that connect something anew."""
        first = len(self.homes)
        self.homes = np.concatenate([self.homes, values[~probes]])
        self.root.extend(range(first, len(self.homes)))
        step = max(1, (1 << 20) // max(1, len(self.homes)))
        for chunk, own in ((values[~probes], True), (values[probes], False)):
            for at in range(0, len(chunk), step):
                part = chunk[at:at + step]
                near = np.bitwise_count(part[:, None] ^ self.homes[None, :]) <= self.radius
                for i in np.flatnonzero(near.any(axis=1)):
                    met = np.flatnonzero(near[i])
                    if not own and part[i] != self.homes[met[0]]:
                        out.append((part[i], self.homes[met[0]]))
                    base = first + at + i if own else met[0]
                    for j in met:
                        a, b = self._find(base), self._find(j)
                        if a != b:
                            self.root[a] = b
                            out.append((self.homes[base], self.homes[j]))


def _linking(radius: int):
    """Edges within each bucket of rows sorted by (segment, key, part, probe), as many as connect it and no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, forest = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            probe = batch.column(3).to_numpy(zero_copy_only=False) != 0
            value = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(axis=0)])
            stops = np.r_[starts[1:], batch.num_rows]
            out: list = []
            for n, (i, j) in enumerate(zip(starts, stops)):
                last = n == len(starts) - 1
                if n and not last and (j - i == 1 or probe[i]):
                    continue  # a bucket with one entry, or with none of its own
                here = tuple(ids[:, i])
                if here != name:
                    name, forest = here, _Forest(radius)
                forest.add(value[i:j], probe[i:j], out)
            edges = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return run


def linking_edges(distinct: DataFrame, radius: int = 3, segments: int = 2, bucket: int = 1024) -> DataFrame:
    """Edges (a, b) between the fingerprints of ``distinct`` that connect just those within ``radius`` bits of each other.

    Each bucket of equal segment values compares its own entries with all that probe it and returns a spanning forest,
    so its rows grow with its entries, not their pairs. A bucket with over ``bucket`` entries of its own is split into
    parts; the others of the bucket are sent to every part, so that no comparison is lost.
    """
    entries = distinct.select("fingerprint", F.inline(_ball(segments, radius)))
    sizes = entries.where("probe = 0").groupBy("segment", "key").agg(F.count(F.lit(1)).alias("own"))
    large = stored(sizes.where(F.col("own") > bucket), "large-buckets")
    if large.isEmpty():
        dealt = entries.withColumn("part", F.lit(0))
    else:
        joined = entries.join(large, ["segment", "key"], "left")
        parts = F.coalesce(F.ceil(F.col("own") / bucket), F.lit(1))
        home = F.pmod(F.hash("fingerprint"), parts).cast("int")
        spread = joined.withColumn("home", home).withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
        foreign = (F.col("probe") == 1) | (F.col("part") != F.col("home"))
        dealt = spread.withColumn("probe", foreign.cast("int"))
    dealt = dealt.select("segment", "key", "part", "probe", "fingerprint").repartition("segment", "key", "part")
    ordered = dealt.sortWithinPartitions("segment", "key", "part", "probe")
    return ordered.mapInArrow(_linking(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, k: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", segments: int = 2
) -> DataFrame:
    """(id, fingerprint long, component_id) for each row of ``docs``.

    Rows are linked if their fingerprints differ in at most ``radius`` of 64 bits; ``component_id`` is the smallest id
    reachable over links, the row's own included. Null ids take part but name no component: it is null where all its
    ids are. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, k, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min(id_col).alias("first")), "distinct")
    labels = components(linking_edges(distinct, radius, segments))
    linked = stored(labels.join(distinct, labels.node == distinct.fingerprint).select("node", "label", "first"), "linked")
    least = stored(linked.groupBy("label").agg(F.min("first").alias("least")), "least")
    named = stored(linked.join(least, "label").select("node", "least"), "named")
    alone = distinct.join(named, distinct.fingerprint == named.node, "left")
    component = stored(alone.select("fingerprint", F.coalesce("least", "first").alias("component_id")), "components")
    return prints.join(component, "fingerprint").select(id_col, "fingerprint", "component_id")
