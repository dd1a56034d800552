"""Benchmark decontamination: SimHash of item-sized windows, found by multi-index Hamming blocks and verified exactly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.simhash import BITS, bit_counts, majority, shingle
from assayer.llm.text import ascii_lower, stored, words

#: About so many benchmark shingles are sent to every executor at once; more are taken in several passes.
AT_ONCE = 500_000


def _hash(k: int, shift: int = 0) -> Column:
    return F.xxhash64(*[F.expr(f"try_element_at(words, pos + {i + 1 + shift})") for i in range(k)])


def _placed(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` once for each position ``pos`` of ``words`` that starts a shingle; a shorter text is one shingle, all it has."""
    return rows.select("*", F.posexplode("words").alias("pos", "word")).where(f"pos = 0 or pos <= size(words) - {k}")


def _blocks(radius: int) -> Column:
    """(block, value) of radius + 1 disjoint blocks of ``fingerprint``: two within ``radius`` bits agree in one of them."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[
        F.struct(
            F.lit(i).alias("block"),
            F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("value"),
        )
        for i, (low, high) in enumerate(zip(cuts, cuts[1:]))
    ])


def _regions(docs: DataFrame, known: DataFrame, longest: int, k: int) -> DataFrame:
    """Each shingle of the documents near one of ``known``: (row_no, doc_id, doc_length, pos, h, sid).

    ``known`` has (h, shingle, sid) of all items; ``sid`` is null for shingles they do not have. A document is cut where
    a run of known shingles begins, and again every ``longest`` words of the run; the cut reaches ``longest`` words back
    and twice as many ahead, so it holds every window that has its first known shingle there. Words, hashes and look-ups
    stay in one generated loop over the text.
    """
    index = F.broadcast(known.select("h").distinct())
    before = F.broadcast(known.select(F.col("h").alias("h_before"), F.lit(True).alias("in_run")).distinct())
    met = _placed(docs, k).withColumn("h", _hash(k)).join(index, "h", "left_semi")
    previous = met.withColumn("h_before", F.when(F.col("pos") > 0, _hash(k, -1)))
    begins = previous.join(before, "h_before", "left").where(f"in_run is null or pos % {longest} = 0")
    base = F.greatest(F.col("pos") - longest, F.lit(0))
    cuts = stored(
        begins.select("row_no", "doc_id", F.size("words").alias("doc_length"), base.alias("base"),
                      F.slice("words", base + 1, F.lit(3 * longest + k)).alias("words")),
        "cuts",
    )
    inner = _placed(cuts, k).select(
        "row_no", "doc_id", "doc_length", (F.col("base") + F.col("pos")).alias("pos"), _hash(k).alias("h"),
        shingle(k).alias("shingle"),
    )
    told = inner.join(F.broadcast(known), ["h", "shingle"], "left").drop("shingle").repartition("row_no")
    once = told.groupBy("row_no", "doc_id", "doc_length", "pos")
    return stored(once.agg(F.min("h").alias("h"), F.min("sid").alias("sid")), "regions")


def _rarest(items: DataFrame, similarity: float, width: Column) -> DataFrame:
    """(item_no, length, sid): as many of the rarest shingles of each item, repeats included, as a similar window can
    lack, and one more. A similar window has a share of ``similarity`` of the item's shingles, so it has one of these."""
    spread = items.groupBy("sid").agg(F.count_distinct("item_no").alias("spread"))
    place = F.row_number().over(Window.partitionBy("item_no").orderBy("spread", "sid"))
    placed = items.join(spread, "sid").select("item_no", "length", "sid", place.alias("place"))
    return placed.where(F.col("place") <= width - F.ceil(similarity * width - 1e-9) + 1).drop("place").distinct()


def _matches(docs: DataFrame, items: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    """(row_no, doc_id, item_no, item_id, similarity, start, words) of all similar windows."""
    longest = items.agg(F.max("length")).first()[0] or 1
    texts = items.select("h", "shingle").distinct()
    known = stored(texts.withColumn("sid", F.monotonically_increasing_id()), "shingles")
    items = stored(items.join(known, ["h", "shingle"]).drop("shingle"), "numbered")
    regions = _regions(docs, known, longest, k)
    width = F.greatest(F.col("length") - (k - 1), F.lit(1))
    own_words = F.least("length", "doc_length")  # a document shorter than the item is one window, all it has
    own_width = F.greatest(own_words - (k - 1), F.lit(1))

    # windows with enough known shingles of their size
    hits = regions.join(F.broadcast(items.select("sid", "length").distinct()), "sid")
    fits = (F.col("length") >= k) | (F.col("doc_length") == F.col("length"))
    last = F.least(F.col("pos"), F.col("doc_length") - own_words)
    first = F.greatest(F.lit(0), F.col("pos") - width + 1)
    starts = F.when(fits & (last >= first), F.sequence(first, last))
    keys = ["row_no", "doc_id", "doc_length", "length", "start"]
    covered = hits.select("row_no", "doc_id", "doc_length", "length", F.explode(starts).alias("start"))
    enough = covered.groupBy(*keys).agg(F.count(F.lit(1)).alias("known"))
    windows = enough.where(F.col("known") >= similarity * width - 1e-9).drop("known")

    # their fingerprints, and which known shingles they have
    steps = F.explode(F.sequence("start", F.col("start") + own_width - 1)).alias("pos")
    inside = windows.select("*", steps).join(regions.drop("doc_id", "doc_length"), ["row_no", "pos"])
    gathered = inside.drop("pos").repartition("row_no", "length", "start").groupBy(*keys).agg(
        F.count("h").alias("n"), *bit_counts(F.col("h")), F.collect_list("sid").alias("sids"),
        F.size(F.collect_set("h")).alias("kinds"),
    )
    special = (F.col("doc_length") < F.col("length")) | (F.col("kinds") < F.col("n"))
    signed = stored(
        gathered.select(*keys, special.alias("special"), majority(F.col("n")).alias("fingerprint"), "sids"), "signed"
    )
    plain = signed.where("not special")

    # items within the radius, by blocks
    counted = items.groupBy("item_no", "length").agg(
        F.count("h").alias("n"), *bit_counts(F.col("h")), F.size(F.collect_set("h")).alias("kinds")
    )
    marks = counted.where("kinds = n").select("item_no", "length", majority(F.col("n")).alias("fingerprint"))
    probes = plain.select("length", "fingerprint").distinct().select("length", "fingerprint", F.inline(_blocks(radius)))
    table = marks.select("item_no", "length", F.col("fingerprint").alias("mark"), F.inline(_blocks(radius)))
    apart = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("mark")))
    p, t = probes.alias("p"), table.alias("t")
    same = [F.col(f"p.{c}") == F.col(f"t.{c}") for c in ("length", "block", "value")]
    near = p.join(t, [*same, apart <= radius]).select("p.length", "fingerprint", "item_no").distinct()
    by_mark = plain.join(stored(near, "near"), ["length", "fingerprint"]).select(*keys, "item_no", "sids")

    # items that share one of their rarest shingles with a window, where fingerprints do not suit one of the two
    repeating = counted.where("kinds < n").select("item_no", F.lit(True).alias("repeating"))
    rarest = stored(_rarest(items, similarity, width).join(repeating, "item_no", "left"), "rarest")
    has = signed.select("row_no", "length", "start", "special", F.explode(F.array_distinct("sids")).alias("sid"))
    unsuited = has.join(F.broadcast(rarest), ["length", "sid"]).where("special or repeating")
    sharing = unsuited.select("row_no", "length", "start", "item_no").distinct()
    by_share = signed.join(stored(sharing, "sharing"), ["row_no", "length", "start"]).select(*keys, "item_no", "sids")
    found = by_mark.union(by_share)

    # exact weighted similarity, repeats included
    times = F.transform(
        F.array_distinct("sids"),
        lambda s: F.struct(s.alias("sid"), F.size(F.filter("sids", lambda x: x == s)).alias("here")),
    )
    listed = found.select(*keys, "item_no", F.inline(times))
    wanted = items.groupBy("item_no", "item_id", "sid").agg(F.count(F.lit(1)).alias("there"))
    both = listed.join(F.broadcast(wanted), ["item_no", "sid"])
    shared = both.groupBy(*keys, "item_no", "item_id").agg(F.sum(F.least("here", "there")).alias("shared"))
    scored = shared.withColumn("similarity", F.col("shared") / (own_width + width - F.col("shared")))
    similar = scored.where(F.col("similarity") >= similarity - 1e-9)
    return similar.select("row_no", "doc_id", "item_no", "item_id", "similarity", "start", own_words.alias("words"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = 5,
    similarity: float = 0.8,
    radius: int = 23,
    id_col: str = "doc_id",
    at_once: int = AT_ONCE,
) -> DataFrame:
    """(id, item_id, similarity, word_start, words): for each document and item it contains, its most similar window.

    A window has as many words as the item; a document shorter than the item is one window, all its words. A window
    matches if the weighted Jaccard similarity of the two texts' shingles of ``k`` words, repeats included, is at least
    ``similarity``; of equally similar windows the first is returned. Words are lower-cased in A-Z and split at spaces,
    tabs and line breaks.

    1. A window can only be similar enough if a share of ``similarity`` of its positions start a shingle of items of its
       size. One pass over the words cuts out the places around known shingles; windows are counted there. Exact.
    2. Each such window gets a SimHash fingerprint, and ``radius`` + 1 blocks of it meet those of the items of its
       size: every item within ``radius`` bits is found. If no shingle repeats, a bit differs with probability 0.151 or
       less at similarity 0.8, so a similar window lies beyond the default radius about once in 100,000. Repeats lean
       the bits to one side and short documents are of another size, so windows and items with a repeated shingle, and
       documents shorter than the item, do not go this way: such a window meets every item, and such an item every
       window, where the window has one of the item's rarest shingles. Exact.
    3. Candidates are verified on the shingles themselves.

    The benchmark is taken in parts of about ``at_once`` shingles, one pass over the documents each, so what executors
    hold of it is bounded. Null and blank texts of either side match nothing, and items with a null id are left out. An
    item of fewer than ``k`` words matches only a document of the same words. Rows that share an id, of either table,
    are searched apart and reported as one. Empty tables give no rows.
    """
    listed = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(id_col).alias("doc_id"),
        words(ascii_lower(F.col("text"))).alias("words"),
    )
    texts = benchmark.where("item_id is not null").select(
        F.monotonically_increasing_id().alias("item_no"), "item_id", words(ascii_lower(F.col("text"))).alias("words")
    )
    items = stored(
        _placed(texts, k).select("item_no", "item_id", F.size("words").alias("length"), _hash(k).alias("h"),
                                 shingle(k).alias("shingle")),
        "items",
    )
    parts = max(1, -(-items.count() // at_once))
    own = [items.where(F.pmod(F.xxhash64("item_no"), F.lit(parts)) == i) for i in range(parts)]
    found = reduce(DataFrame.union, [_matches(listed, part, k, similarity, radius) for part in own])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "words"))
    kept = found.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return kept.select(
        F.col("doc_id").alias(id_col), "item_id", F.col("best.similarity").alias("similarity"),
        (-F.col("best.back")).alias("word_start"), F.col("best.words").alias("words"),
    )
