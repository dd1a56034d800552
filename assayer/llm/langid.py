"""Language by words first: known words count by their frequency in each language, others by their character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.text import held_out, stored

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)
NONE = "und"
MEMORY = 200_000  # words a worker keeps scored
#: A training sample of up to so many documents (their ids alone) is sent to every executor; a larger one is joined.
BROADCAST_IDS = 500_000
SALTS = 64  # parts of a language in which its sample is chosen first


def tokens(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies, a row for each known word and n-gram, a column for each language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray

    def _rows(self, word: str) -> list[int]:
        """A known word's own row; else the rows of its n-grams of the longest order of which any is known."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        for n in ORDERS:
            if found := [i for i in map(self.grams.get, grams(word, n)) if i is not None]:
                return found
        return []

    def score_words(self, words: list[str]) -> np.ndarray:
        """The mean over each word's rows; zeros where there are none."""
        rows = [self._rows(w) for w in words]
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.array([i for r in rows for i in r], dtype=np.int64)
        out = np.zeros((len(words), len(self.languages)))
        if len(flat):
            some = np.flatnonzero(sizes)
            sums = np.add.reduceat(self.logs[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
            out[some] = sums / sizes[some, None]
        return out


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, token, n): words as order 0 and their n-grams, summed within a batch."""
    for batch in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(*[c.to_pylist() for c in batch.columns]):
            seen.setdefault(lang, Counter()).update(tokens(text))
        for lang, words in seen.items():
            counts = Counter({(0, w): n for w, n in words.items()})
            for w, n in words.items():
                for order in ORDERS:
                    for g in grams(w, order):
                        counts[order, g] += n
            kinds, names = zip(*counts) if counts else ((), ())
            yield pa.record_batch(
                [pa.array([lang] * len(counts), pa.string()), pa.array(kinds, pa.int32()), pa.array(names, pa.string()),
                 pa.array(list(counts.values()), pa.int64())], names=["lang", "kind", "token", "n"],
            )


def sample_ids(usable: DataFrame, per_language: int) -> DataFrame:
    """(lang, doc_id) of the first ``per_language`` rows of each language in the order of a hash.

    The first of each part of a language hold the first of the whole, so what meets in one task is bounded.
    """

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id"))
        return rows.withColumn("place", place).where(F.col("place") <= per_language).drop("place")

    salted = usable.select("lang", "doc_id", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"))
    return first(first(salted, "lang", "salt"), "lang").select("lang", "doc_id").distinct()


def train(docs: DataFrame, per_language: int = 1000, words: int = 20_000, ngrams: int = 4_000) -> Model:
    """Learn from whole texts of at most ``per_language`` documents of each language, chosen by hash, none held out.

    The model keeps the ``words`` most frequent words of each language that occur twice at least, and the ``ngrams``
    most frequent n-grams of each order: its size is bounded per language, whatever the corpus.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = stored(sample_ids(usable, per_language), "language-sample")
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    sample = usable.join(chosen, ["lang", "doc_id"]).select("lang", "text")
    counted = sample.mapInArrow(_counting, "lang string, kind int, token string, n long")
    total = counted.groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))
    kinds = Window.partitionBy("lang", "kind")
    ranked = total.select(
        "*", F.sum("n").over(kinds).alias("mass"), F.row_number().over(kinds.orderBy(F.desc("n"), "token")).alias("place")
    )
    limit = F.when(F.col("kind") == 0, words).otherwise(ngrams)
    kept = ranked.where((F.col("place") <= limit) & ((F.col("kind") > 0) | (F.col("n") > 1)))
    return _model(kept.select("lang", "kind", "token", "n", "mass").toPandas())


def _model(rows) -> Model:
    languages = sorted(set(rows["lang"]))
    column = {lang: i for i, lang in enumerate(languages)}
    mass = {(r.lang, r.kind): r.mass for r in rows[["lang", "kind", "mass"]].drop_duplicates().itertuples()}
    least = {
        kind: np.array([np.log(0.5 / mass.get((lang, kind), 1)) for lang in languages]) for kind in (0, *ORDERS)
    }
    tables: tuple[dict, dict] = ({}, {})
    logs = []
    for r in rows.itertuples():
        row = tables[r.kind > 0].setdefault(r.token, len(logs))
        if row == len(logs):
            logs.append(least[r.kind].copy())
        logs[row][column[r.lang]] = np.log(r.n / r.mass)
    return Model(languages, *tables, np.array(logs, dtype=float).reshape(len(logs), len(languages)))


class Scorer:
    """A model with a bounded memory of words already scored."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.empty((MEMORY, len(self.model.languages)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [tokens(t or "") for t in texts]
        fresh = [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in self.index]
        if len(self.index) + len(fresh) > len(self.rows):
            self._forget()
            fresh = list(dict.fromkeys(chain.from_iterable(found)))
            self.rows = np.empty((max(MEMORY, len(fresh)), len(self.model.languages)))
        first = len(self.index)
        self.rows[first:first + len(fresh)] = self.model.score_words(fresh)
        self.index.update(zip(fresh, range(first, first + len(fresh))))
        return [self._one(words) for words in found]

    def _one(self, words: list[str]) -> tuple[str, float]:
        if not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return NONE, 0.0
        total = self.rows[list(map(self.index.__getitem__, words))].sum(axis=0)
        # the words of a text are not independent: evidence counts as that of a few dozen of them at most
        z = total * (min(len(words), 30) / len(words))
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.model.languages[best], float(p[best] / p.sum())


SCHEMA = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predicting(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            langs, scores = [], []
            texts = batch.column(2).to_pylist()
            for at in range(0, len(texts), 200):
                for lang, score in scorer.predict(texts[at:at + 200]):
                    langs.append(lang)
                    scores.append(score)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()),
                                   pa.array(scores, pa.float64())], schema=SCHEMA)

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of ``docs``, from its whole text alone.

    ``score`` is the share of the best language among all. Texts that are null or have no letter are ``und`` with score
    0, as is every text where nothing could be learned. Of equally good languages the first by name is taken. Rows that
    share an id are read apart; an empty table gives no rows.
    """
    ident = F.col(id_col).cast("long")
    rows = docs.select(ident.alias("id"), held_out(ident).alias("held_out"), F.col(text_col).alias("text"))
    fields = "id long, held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(_predicting(model), fields).withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not ``und``; rows are judged where they are, without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs = [lang for i in range(0, len(texts), 200) for lang, _ in scorer.predict(texts[i:i + 200])]
            yield batch.filter(pa.array([lang != NONE for lang in langs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
