"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.text import GAP, stored
from assayer.operators.ranking import number_rows

#: The draw of a row is taken from md5, which any SQL engine can repeat.
SEED = "mix-1"


def draw(seed: str, *keys: Column) -> Column:
    """60 bits of md5 over the seed and the keys."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def token_count(text: Column) -> Column:
    """Number of words, runs of anything but space, tab and line breaks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(GAP.replace("[", "[^", 1))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Each source's target: ``share`` of all tokens by weight, but at most ``most`` times what the source has.

    ``sizes`` has (source, source_size). The excess over a cap is shared anew by weight among the others until none is
    above: that leaves a common level per weight, found over the sources in the order in which they reach their caps.
    Sources are few: the windows over all of them see one row per source.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    listed = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    with_cap = ranked.withColumn("weight", listed).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    levelled = (
        with_cap.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("left_cap", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_cap") / F.col("left_weight"))
        .withColumn("free", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
        .withColumn("final", F.max("free").over(everything))
    )
    target = F.least(F.col("final") * F.col("weight"), F.col("cap").cast("double"))
    return levelled.select("source", "rank", "source_size", target.cast("double").alias("target"))


def apportion(votes: DataFrame, group: list[str], party: str) -> DataFrame:
    """Seats of each party of a group by the highest quotients votes / (2 j + 1), j = 0, 1, ..., at most ``room`` a party.

    ``votes`` is a stored table with the group columns, ``party``, ``votes``, ``room`` and ``seats`` (of its group). Only
    the quotients near the last winning one are listed: the fair share of a party, rounded, is off by less than its share
    of one seat per party, so all quotients well above it win and all well below it lose. Sums of a group are
    partial aggregates joined back, and the listed quotients are numbered in stretches, so a group may have any number of
    parties.
    """
    total = votes.groupBy(*group).agg(F.sum("votes").alias("total"), F.count(F.lit(1)).alias("parties"))

    def with_sums(rows: DataFrame, sums: DataFrame) -> DataFrame:
        if group:
            return rows.join(stored(sums, "sums"), group)
        (one,) = sums.collect()  # a single group, a single row
        return rows.withColumns({name: F.lit(one[name]) for name in sums.columns})

    known = with_sums(votes, total)
    fair = F.coalesce(F.col("seats") * F.col("votes") / F.when(F.col("total") > 0, F.col("total")), F.lit(0.0))
    share = F.ceil(F.col("parties") * F.col("votes") / F.when(F.col("total") > 0, F.col("total"))) + 2
    shared = known.withColumn("fair", fair).withColumn("margin", F.coalesce(share, F.lit(2)))
    sure = F.least(F.greatest(F.floor("fair") - F.col("margin"), F.lit(0)), F.col("room")).cast("long")
    # what others cannot take for want of room is shared again, so a party may get more than its fair share
    spare = F.greatest(F.lit(0.0), F.col("fair") - F.col("room"))
    shared = shared.withColumns({"sure": sure, "over": spare})
    sums = shared.groupBy(*group).agg(F.sum("sure").alias("given"), F.sum("over").alias("spare"))
    last = F.least(F.ceil(F.col("fair") + F.col("spare")) + F.col("margin"), F.col("room")).cast("long")
    bounded = with_sums(shared.drop("over"), sums).withColumn("last", last)
    contested = bounded.withColumn("open", F.col("seats") - F.col("given"))
    quotients = F.when(F.col("last") > F.col("sure"), F.sequence(F.col("sure"), F.col("last") - 1))
    entries = contested.select(*group, party, "votes", "sure", "open", F.explode_outer(quotients).alias("j"))
    quotient = F.col("votes") / (2 * F.col("j") + 1)
    placed = number_rows(entries, group, [quotient.desc_nulls_last(), F.asc_nulls_last(party), F.asc("j")], "place")
    won = (F.col("j").isNotNull() & (F.col("place") <= F.col("open"))).cast("long")
    return placed.withColumn("won", won).groupBy(*group, party, "sure").agg(F.sum("won").alias("won")).select(
        *group, party, (F.col("sure") + F.col("won")).alias("quota")
    )


def _overlap(low: Column, high: Column) -> Column:
    """Tokens of a document's stretch [start, stop) that lie in [low, high)."""
    return F.greatest(F.lit(0), F.least(F.col("stop"), high) - F.greatest(F.col("start"), low))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block: int = 16,
    shard: int = 1 << 20,
    seed: str = SEED,
    id_col: str = "doc_id",
    row_col: str | None = None,
) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of ``docs``: how many of its tokens the mix takes.

    Blocks of ``block`` tokens go to sources by Sainte-Laguë quotients of their targets, and each source's blocks to its
    shards by those of their sizes; a shard holds about ``shard`` tokens, so a source of any size is spread over as many
    tasks as it needs. Within a shard, documents lie in seeded order and blocks are cut from them end to end. A quota of
    whole rounds takes all blocks; what is left over takes a run of blocks from a seeded start, a random set of
    documents since their order is. No token is taken more than ``most`` times.

    Null and blank texts have size 0 and are never taken. Null is a source of its own, the last. Rows that share an id
    count apart. Rows without an id are drawn by their text, so they are spread like others. ``row_col`` names a column
    that comes in place of the id, to tell rows apart. An empty table gives no rows; sources without tokens have target 0.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    own = F.col(row_col or id_col).alias("id")
    counted = docs.select(own, name.alias("name"), "source", token_count(F.col("text")).alias("size"))
    sized = stored(counted, "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = stored(targets(sizes, weights, share, most), "targets")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard))
    drawn = (
        sized.where("size > 0")
        .join(aims, sized.source.eqNullSafe(aims.source))
        .select("id", "name", "rank", "size", draw(seed, F.col("name")).alias("draw"), shards.alias("shards"))
        .withColumn("shard", F.pmod(draw(seed + "-shard", F.col("name")), "shards"))
    )
    piece = drawn.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"))
    pieces = stored(piece.withColumn("blocks", F.ceil(F.col("shard_size") / block)), "shards")
    room = pieces.groupBy("rank").agg((F.sum("blocks") * most).alias("room"))
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    bids = aims.join(room, "rank").withColumn("seats", seats).select("rank", F.col("target").alias("votes"), "room", "seats")
    won = stored(apportion(stored(bids, "bids"), [], "rank"), "quotas")
    inner = pieces.join(won, "rank").select(
        "rank", "shard", F.col("shard_size").cast("double").alias("votes"),
        (F.col("blocks") * most).alias("room"), F.col("quota").alias("seats"),
    )
    quotas = apportion(stored(inner, "bids"), ["rank"], "shard").join(pieces, ["rank", "shard"])
    rounds = F.floor(F.col("quota") / F.col("blocks"))
    run = F.col("quota") - rounds * F.col("blocks")
    begin = F.pmod(draw(seed + "-start", F.col("rank"), F.col("shard")), "blocks")
    plan = stored(
        quotas.select(
            "rank", "shard", "shard_size", rounds.alias("rounds"), (begin * block).alias("low"),
            ((begin + run) * block).alias("high"), (F.col("blocks") * block).alias("span"),
        ),
        "selection",
    )
    order = Window.partitionBy("rank", "shard").orderBy("draw", "name", "size", "id")
    laid = drawn.withColumn("stop", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = laid.withColumn("start", F.col("stop") - F.col("size")).join(plan, ["rank", "shard"])
    extra = _overlap(F.col("low"), F.col("high")) + _overlap(F.lit(0), F.col("high") - F.col("span"))
    chosen = placed.select("id", "rank", "size", (F.col("rounds") * F.col("size") + extra).cast("long").alias("taken"))
    empty = sized.where("size = 0").join(aims, sized.source.eqNullSafe(aims.source))
    rows = chosen.union(empty.select("id", "rank", "size", F.lit(0).cast("long")))
    return rows.join(aims, "rank").select(F.col("id").alias(row_col or id_col), "size", "source_size", "target", "taken")
