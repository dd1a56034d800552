"""Quality rules: counts over words and lines, and bands of perplexity for each language.

The language model is a modified Kneser-Ney model of n-grams of UTF-8 bytes, counted by Spark over all documents. An
n-gram of at most 7 bytes is a number below 2^56, a hash without collisions; the model keeps these in sorted arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.text import stored

ORDER = 5
START, END = b"\xff", b"\xfe"  # bytes that UTF-8 never has
BLANK = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
PIECE = 1 << 20  # bytes of a text that are looked at together
HELD = 1 << 20  # n-grams of a partition that are held before they are handed on
#: Bytes of the arrays that may be sent to every executor; a larger model is joined instead.
SENT = 64 << 20
NO_LANG = "und"
MICRO = 1_000_000  # log probabilities are summed in millionths, so that no order of summing changes a result


def plain_bytes(text: str) -> bytes:
    """What the model reads: lower case, one blank for every run of white space."""
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def grams(data: bytes, order: int) -> Iterator[np.ndarray]:
    """The n-grams that end at each byte of ``data`` and at its end, as numbers; piece by piece."""
    marked = START * (order - 1) + data + END
    last = len(marked) - order + 1
    for at in range(0, last, PIECE):
        part = np.frombuffer(marked[at:at + PIECE + order - 1], np.uint8).astype(np.int64)
        n = len(part) - order + 1
        out = part[:n].copy()
        for i in range(1, order):
            out <<= 8
            out |= part[i:i + n]
        yield out


def _counting(order: int):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        found, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return found, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, parts in seen.items():
                found, n = summed(parts)
                yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], schema=schema)
            seen.clear()

        for batch in batches:
            fresh: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                for found in grams(plain_bytes(text), order):
                    fresh.setdefault(lang, []).append(found)
                if sum(map(len, fresh.get(lang, []))) > 4 * PIECE:
                    seen.setdefault(lang, []).append(np.unique(np.concatenate(fresh.pop(lang)), return_counts=True))
            for lang, parts in fresh.items():
                seen.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
            for lang, parts in seen.items():
                if sum(len(g) for g, _ in parts) > HELD:
                    seen[lang] = [summed(parts)]
            if sum(len(g) for parts in seen.values() for g, _ in parts) > HELD:
                yield from handed_on()
        yield from handed_on()

    return run


@dataclass
class Model:
    """``grams`` (lang, size, gram, logp) for every n-gram seen, ``contexts`` (lang, size, gram, weight) with the log weight
    that is left for bytes not seen after a context, ``floors`` (lang, floor) for bytes not seen at all."""

    grams: DataFrame
    contexts: DataFrame
    floors: DataFrame
    order: int


def _discounts(counted: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): the modified discounts from how many n-grams were counted once to four times.

    Where one of these is missing, 0.5, 1 and 1.5 stand in; no discount is negative.
    """
    n = [F.col(f"n{i}") for i in range(5)]
    ones = counted.groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)])
    y = n[1] / (n[1] + 2 * n[2])
    whole = (n[1] > 0) & (n[2] > 0) & (n[3] > 0) & (n[4] > 0)

    def discount(i: int) -> Column:
        own = F.greatest(F.lit(0.0), i - (i + 1) * y * n[i + 1] / n[i])
        return F.when(whole, own).otherwise(i / 2).alias(f"d{i}")

    return ones.select("lang", *[discount(i) for i in (1, 2, 3)])


def train(docs: DataFrame, order: int = ORDER, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A modified Kneser-Ney model for each language, from the whole text of every document.

    The longest n-grams count as often as they occur; a shorter one counts the different bytes seen before it. A null
    language is one of its own. Null texts teach nothing; neither does an empty table.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be from 2 to 7, so that an n-gram fits a long")
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    parts = texts.where("text is not null").mapInArrow(_counting(order), "lang string, gram long, n long")
    counted = {order: stored(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")}
    for size in range(order - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1))
        shorter = counted[size + 1].groupBy("lang", tail.alias("gram")).agg(F.count("*").alias("n"))
        counted[size] = stored(shorter, "grams")
    vocabulary = counted[1].groupBy("lang").agg(F.count("*").alias("bytes"))
    floors = stored(vocabulary.select("lang", (1 / (F.col("bytes") + 1)).alias("floor")), "floors")
    levels, weights, below = [], [], None
    for size in range(1, order + 1):
        d = [F.col(f"d{i}") for i in (1, 2, 3)]
        n, of = F.col("n"), [F.col(f"of{i}") for i in (1, 2, 3)]
        context, tail = F.shiftright("gram", 8), F.col("gram").bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1))
        known = counted[size].withColumns({"context": context, "tail": tail})
        totals = known.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), F.count_if(n == 1).alias("of1"), F.count_if(n == 2).alias("of2"), F.count_if(n > 2).alias("of3")
        )
        left = (d[0] * of[0] + d[1] * of[1] + d[2] * of[2]) / F.col("total")
        spread = stored(totals.join(_discounts(counted[size]), "lang").withColumn("left", left), "contexts")
        lower = floors.withColumnRenamed("floor", "low") if size == 1 else below.selectExpr("lang", "gram AS tail", "p AS low")
        discount = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        p = (n - discount) / F.col("total") + F.col("left") * F.col("low")
        met = known.join(spread, ["lang", "context"]).join(lower, ["lang"] if size == 1 else ["lang", "tail"])
        below = stored(met.select("lang", "gram", p.alias("p")), "probabilities")
        levels.append(below.select("lang", F.lit(size).alias("size"), "gram", F.log("p").alias("logp")))
        weight = F.log(F.greatest(F.col("left"), F.lit(1e-12))).alias("weight")
        weights.append(spread.select("lang", F.lit(size).alias("size"), F.col("context").alias("gram"), weight))
    every = levels[0]
    contexts = weights[0]
    for level, more in zip(levels[1:], weights[1:]):
        every, contexts = every.union(level), contexts.union(more)
    return Model(every, contexts, floors, order)


# the model in sorted arrays


@dataclass
class Arrays:
    """(language, size) -> (sorted n-grams, their values), for n-grams and for contexts; language -> floor."""

    grams: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    contexts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    floors: dict[str, float]
    order: int

    def logp(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Log probabilities of the last byte of each n-gram; an n-gram that was not seen falls back on its tail."""
        out = np.zeros(len(keys))
        open_, at = np.arange(len(keys)), keys
        for size in range(self.order, 0, -1):
            value, known = _looked_up(self.grams.get((lang, size)), at)
            out[open_] += np.where(known, value, 0.0)
            if known.all():
                return out
            open_, at = open_[~known], at[~known]
            out[open_] += _looked_up(self.contexts.get((lang, size)), at >> 8)[0]
            at = at & ((1 << 8 * (size - 1)) - 1)
        out[open_] += np.log(self.floors.get(lang, 1 / 256))
        return out


def _looked_up(table: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 where a key is not in the table, and whether it is."""
    if table is None or not len(table[0]):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    known = table[0][place] == keys
    return np.where(known, table[1][place], 0.0), known


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, size, gram, value) as a row of bytes for each language and size of a batch."""
    for batch in batches:
        table = batch.to_pandas()
        rows = [(lang, size, g["gram"].to_numpy().tobytes(), g["value"].to_numpy().tobytes()) for (lang, size), g in table.groupby(["lang", "size"])]
        if rows:
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lang", "size", "gram", "value"])


def arrays(model: Model, most: int = SENT) -> Arrays | None:
    """The model as sorted arrays, or None where it is larger than ``most`` bytes (16 for each n-gram and context)."""
    if (model.grams.count() + model.contexts.count()) * 16 > most:
        return None

    def tables(rows: DataFrame, value: str) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
        valued = rows.select("lang", "size", "gram", F.col(value).alias("value"))
        packed = valued.mapInArrow(_packing, "lang string, size int, gram binary, value binary").collect()
        found = {}
        for key in {(r.lang, r.size) for r in packed}:
            own = [r for r in packed if (r.lang, r.size) == key]
            keys, values = (np.frombuffer(b"".join(r[c] for r in own), kind) for c, kind in (("gram", np.int64), ("value", np.float64)))
            order = np.argsort(keys)
            found[key] = keys[order], values[order]
        return found

    floors = {r.lang: r.floor for r in model.floors.collect()}
    return Arrays(tables(model.grams, "logp"), tables(model.contexts, "weight"), floors, model.order)


# counts over words and lines


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words that the text has twice or more."""
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    window = ids  # names of windows, one word longer each time; a name is below the number of words
    for i in range(1, width):
        window = window[:-1] * len(words) + ids[i:]
        _, window = np.unique(window, return_inverse=True)
    twice = np.flatnonzero(np.bincount(window)[window] > 1)
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + width, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "replace")
    words = data.split()  # of bytes: at space, tab and line breaks alone
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(data) - int(of[0x80:0xC0].sum()) - int(of[list(BLANK)].sum())
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), chars, int(of[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SURPRISE = ("nats", "squares", "bytes")


def _measuring(logp: Callable[[str, np.ndarray], np.ndarray] | None, order: int):
    """Rows (row_no, id, lang, *COUNTS), and the sums of surprise where the model is at hand."""
    names = ["row_no", "id", "lang", *COUNTS, *(SURPRISE if logp else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row_no, ident, lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                sums = ()
                if logp:
                    nats = squares = n = 0
                    for keys in grams(plain_bytes(text), order):
                        s = -logp(lang, keys)
                        nats, squares, n = nats + s.sum(), squares + (s * s).sum(), n + len(s)
                    sums = round(nats * MICRO), round(squares * MICRO), n
                rows.append((row_no, ident, lang, *text_counts(text), *sums))
            if rows:
                kinds = [pa.string() if name == "lang" else pa.int64() for name in names]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _listing(order: int):
    """(row_no, lang, gram, n): each document's own n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row_no, _, lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                for keys in grams(plain_bytes(text), order):
                    found, n = np.unique(keys, return_counts=True)
                    yield pa.record_batch(
                        [pa.array([row_no] * len(found), pa.int64()), pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)],
                        names=["row_no", "lang", "gram", "n"],
                    )

    return run


def _surprise_by_joins(rows: DataFrame, model: Model) -> DataFrame:
    """(row_no, *SURPRISE) as ``Arrays.logp`` gives them, with the model joined and not sent."""
    listed = rows.mapInArrow(_listing(model.order), "row_no long, lang string, gram long, n long")
    left = listed.withColumn("back", F.lit(0.0))
    met = None
    for size in range(model.order, 0, -1):
        level = model.grams.where(F.col("size") == size).select("lang", "gram", "logp")
        tried = stored(left.join(level, ["lang", "gram"], "left"), "tried")
        known = tried.where("logp is not null").select("row_no", "n", (F.col("back") + F.col("logp")).alias("logp"))
        met = known if met is None else met.union(known)
        weights = model.contexts.where(F.col("size") == size).select("lang", F.col("gram").alias("context"), "weight")
        unknown = tried.where("logp is null").drop("logp").withColumn("context", F.shiftright("gram", 8))
        tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1))
        left = unknown.join(weights, ["lang", "context"], "left").select(
            "row_no", "lang", tail.alias("gram"), "n", (F.col("back") + F.coalesce("weight", F.lit(0.0))).alias("back")
        )
    lost = left.join(model.floors, "lang", "left").select(
        "row_no", "n", (F.col("back") + F.log(F.coalesce("floor", F.lit(1 / 256)))).alias("logp")
    )
    s = -F.col("logp")
    return met.union(lost).groupBy("row_no").agg(
        F.round(F.sum(F.col("n") * s) * MICRO).cast("long").alias("nats"),
        F.round(F.sum(F.col("n") * s * s) * MICRO).cast("long").alias("squares"), F.sum("n").alias("bytes"),
    )


def measure(
    docs: DataFrame, model: Model, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", most: int = SENT
) -> DataFrame:
    """(id, lang, *COUNTS, *SURPRISE) for each row of ``docs``: surprise in millionths of a nat over its bytes.

    Sorted arrays of up to ``most`` bytes are sent to the executors; a larger model is joined, with the same result.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    kinds = "row_no long, id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS)
    packed = arrays(model, most)
    if packed is None:
        rows = stored(rows, "numbered")
        counted = rows.mapInArrow(_measuring(None, model.order), kinds)
        return counted.join(_surprise_by_joins(rows, model), "row_no").drop("row_no")
    sent = docs.sparkSession.sparkContext.broadcast(packed)
    run = _measuring(lambda lang, keys: sent.value.logp(lang, keys), model.order)
    return rows.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} long" for c in SURPRISE)).drop("row_no")


STEPS = 1000  # steps of the logarithm that a quartile is read off at


def bands(measured: DataFrame) -> DataFrame:
    """(lang, middle, spread, noise): the median of log perplexity a word over all documents with words, its spread by the
    quartiles, and the variance of a byte's surprise.

    Quartiles are read off a histogram with steps of a thousandth, so a language of any size is a bounded number of bins.
    """
    x = F.col("nats") / MICRO / F.col("n_words")
    with_words = measured.where("n_words > 0")
    step = F.round(F.log(F.greatest(x, F.lit(1e-6))) * STEPS).cast("int")
    bins = with_words.groupBy("lang", step.alias("step")).agg(
        F.count("*").alias("n"), F.sum("nats").alias("nats"), F.sum("squares").alias("squares"), F.sum("bytes").alias("bytes")
    )
    up_to = Window.partitionBy("lang").orderBy("step")
    whole = Window.partitionBy("lang")
    placed = bins.select("*", F.sum("n").over(up_to).alias("below"), F.sum("n").over(whole).alias("of"))

    def quantile(q: float) -> Column:
        return F.exp(F.min(F.when(F.col("below") >= q * F.col("of"), F.col("step"))) / STEPS)

    mean = F.sum("nats") / MICRO / F.sum("bytes")
    noise = F.greatest(F.lit(0.0), F.sum("squares") / MICRO / F.sum("bytes") - mean * mean)
    return placed.groupBy("lang").agg(
        quantile(0.5).alias("middle"), ((quantile(0.75) - quantile(0.25)) / 1.349).alias("spread"), noise.alias("noise")
    )


def quality(
    docs: DataFrame,
    order: int = ORDER,
    width: float = 4.5,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    most: int = SENT,
) -> DataFrame:
    """(id, *COUNTS, base_failed, log_perplexity, lower, upper, kept) for each row of ``docs``, from its whole text.

    A document fails the base rules with under 10 words, or with over a fifth of its words in windows of five words that
    the text repeats. Of the others, those whose log perplexity a word lies within the band of their language are
    kept. A band is its language's median, ``width`` times the expected deviation up and down: the spread of all
    documents and, for the few words of a short one, the noise of single bytes.

    Null texts count as empty: no word, no perplexity, not kept. A null language is one of its own. Rows that share an
    id are judged apart, other columns are not looked at, and an empty table gives no rows.
    """
    model = train(docs, order, lang_col, text_col)
    measured = stored(measure(docs, model, id_col, lang_col, text_col, most), "measured")
    limits = stored(bands(measured), "bands")
    judged = measured.join(limits, "lang", "left")
    words = F.col("n_words")
    x = F.when(words > 0, F.col("nats") / MICRO / words)
    off = width * F.sqrt(F.col("spread") * F.col("spread") + F.col("noise") * F.col("bytes") / (words * words))
    half = off + F.col("middle") / STEPS  # and a step of the histogram
    failed = (words < 10) | (100 * F.col("n_repeat_words") > 20 * words)
    shown = judged.select(
        F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"), x.alias("log_perplexity"),
        F.when(words > 0, F.col("middle") - half).alias("lower"), F.when(words > 0, F.col("middle") + half).alias("upper"),
    )
    within = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return shown.withColumn("kept", ~F.col("base_failed") & within)
