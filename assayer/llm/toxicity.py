"""Toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs."""

from __future__ import annotations

import random
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import held_out, stored

WORD = re.compile(r"[^\W_]+")
LENGTH, STRIDE = 32, 16  # words of a window, and from one window to the next
UNITS, WORD_SIZE, CHAR_SIZE = 8, 8, 8
VOCABULARY, CHAR_BUCKETS = 8000, 4096
BLOCK = 2048  # windows scored at once
MEMORY = 200_000  # words a worker keeps the inputs of


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window_starts(n: int) -> range | list[int]:
    """Starts of overlapping windows that cover ``n`` words; the last one ends with the text."""
    if n <= LENGTH:
        return [0] if n else []
    return [*range(0, n - LENGTH, STRIDE), n - LENGTH]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all the words in a row, and how many each word has; ends are marked."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes + 2)
    mixed = (flat[:-2] * np.uint32(2654435761) + flat[1:-1] * np.uint32(40503) + flat[2:] * np.uint32(2246822519)) >> 12
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return (mixed[inside[:-2]] % CHAR_BUCKETS).astype(np.int64), sizes


def _sum_runs(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over runs of the given sizes, none of which is 0."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    vocabulary: dict[str, int]
    prior: float = 0.0
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], prior: float, seed: int = 0) -> Network:
        draw = np.random.default_rng(seed)
        inputs = WORD_SIZE + CHAR_SIZE

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        p = {"words": normal(len(vocabulary) + 1, WORD_SIZE, scale=0.1), "chars": normal(CHAR_BUCKETS, CHAR_SIZE, scale=0.3)}
        for way in ("f", "b"):
            p |= {
                f"in_{way}": normal(inputs, 3 * UNITS, scale=inputs**-0.5), f"bias_{way}": np.zeros(3 * UNITS, np.float32),
                f"gate_{way}": normal(UNITS, 2 * UNITS, scale=UNITS**-0.5), f"cand_{way}": normal(UNITS, UNITS, scale=UNITS**-0.5),
            }
        p |= {"attend": normal(2 * UNITS, scale=0.3), "out": normal(2 * UNITS, scale=0.3), "bias": np.zeros(1, np.float32)}
        return cls(vocabulary, prior, p)

    # inputs of words

    def word_rows(self, words: list[str]) -> np.ndarray:
        return np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64)

    def inputs(self, words: list[str]) -> np.ndarray:
        """A word's own vector beside the mean vector of its character trigrams."""
        flat, sizes = trigrams(words)
        chars = _sum_runs(self.p["chars"][flat], sizes) / sizes[:, None].astype(np.float32)
        return np.hstack([self.p["words"][self.word_rows(words)], chars])

    def gates_in(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x @ self.p[f"in_{way}"] + self.p[f"bias_{way}"] for way in ("f", "b"))

    # windows

    def _pass(self, way: str, pre: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, windows, units) of one direction; ``keep`` gets what the way back needs."""
        steps = range(LENGTH) if way == "f" else range(LENGTH - 1, -1, -1)
        h = np.zeros((len(ids), UNITS), np.float32)
        states = np.empty((LENGTH, len(ids), UNITS), np.float32)
        gate, cand, whole = self.p[f"gate_{way}"], self.p[f"cand_{way}"], mask.all()
        for t in steps:
            x = pre[ids[:, t]]
            both = _sigmoid(x[:, :2 * UNITS] + h @ gate)
            z, r = both[:, :UNITS], both[:, UNITS:]
            c = np.tanh(x[:, 2 * UNITS:] + (r * h) @ cand)
            new = h + z * (c - h)
            if not whole:
                new = np.where(mask[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, c))
            h = states[t] = new
        return states

    def _pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.where(mask.T, states @ self.p["attend"], np.float32(-1e9))
        share = np.exp(e - e.max(axis=0))
        share /= share.sum(axis=0)
        pooled = np.einsum("tn,tnu->nu", share, states)
        return share, pooled, pooled @ self.p["out"] + self.p["bias"]

    def logits(self, pre: tuple[np.ndarray, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._pass(w, p, ids, mask) for w, p in zip("fb", pre)], axis=2)
        return self._pool(states, mask)[2]

    def gradients(self, words: list[str], ids: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over windows, by back-propagation through attention and time."""
        x = self.inputs(words)
        pre, kept = self.gates_in(x), ([], [])
        states = np.concatenate([self._pass(w, p, ids, mask, k) for w, p, k in zip("fb", pre, kept)], axis=2)
        share, pooled, logit = self._pool(states, mask)
        d_logit = ((_sigmoid(logit) - labels) / len(labels)).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_share = np.einsum("nu,tnu->tn", d_pooled, states)
        d_e = share * (d_share - (share * d_share).sum(axis=0))
        g["attend"] = np.einsum("tn,tnu->u", d_e, states)
        d_states = share[:, :, None] * d_pooled + d_e[:, :, None] * self.p["attend"]
        order = np.argsort(ids, axis=None, kind="stable")
        seen, first = np.unique(ids.ravel()[order], return_index=True)
        d_x = np.zeros_like(x)
        for i, way in enumerate("fb"):
            d_pre = self._back(way, kept[i], d_states[:, :, i * UNITS:(i + 1) * UNITS], mask, g)
            d_rows = np.zeros((len(words), 3 * UNITS), np.float32)
            d_rows[seen] = np.add.reduceat(d_pre.reshape(-1, 3 * UNITS)[order], first, axis=0)
            g[f"in_{way}"], g[f"bias_{way}"] = x.T @ d_rows, d_rows.sum(axis=0)
            d_x += d_rows @ self.p[f"in_{way}"].T
        g["words"], g["chars"] = np.zeros_like(self.p["words"]), np.zeros_like(self.p["chars"])
        np.add.at(g["words"], self.word_rows(words), d_x[:, :WORD_SIZE])
        flat, sizes = trigrams(words)
        np.add.at(g["chars"], flat, np.repeat(d_x[:, WORD_SIZE:] / sizes[:, None], sizes, axis=0))
        return g

    def _back(self, way: str, kept: list, d_states: np.ndarray, mask: np.ndarray, g: dict) -> np.ndarray:
        gate, cand = self.p[f"gate_{way}"], self.p[f"cand_{way}"]
        g[f"gate_{way}"], g[f"cand_{way}"] = np.zeros_like(gate), np.zeros_like(cand)
        d_pre = np.zeros((d_states.shape[1], LENGTH, 3 * UNITS), np.float32)
        d_h = np.zeros(d_states.shape[1:], np.float32)
        for t, h, z, r, c in reversed(kept):
            d_new = d_h + d_states[t]
            here = d_new * mask[:, t, None]
            d_cand = here * z * (1 - c * c)
            d_rh = d_cand @ cand.T
            d_both = np.hstack([here * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)])
            d_pre[:, t, :2 * UNITS], d_pre[:, t, 2 * UNITS:] = d_both, d_cand
            g[f"gate_{way}"] += h.T @ d_both
            g[f"cand_{way}"] += (r * h).T @ d_cand
            d_h = d_new - here * z + d_rh * r + d_both @ gate.T
        return d_pre


def _indexed(windows: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, and for each window their places and which of its steps hold a word."""
    index: dict[str, int] = {}
    ids = np.zeros((len(windows), LENGTH), np.int64)
    mask = np.zeros((len(windows), LENGTH), bool)
    for i, words in enumerate(windows):
        ids[i, :len(words)] = [index.setdefault(w, len(index)) for w in words]
        mask[i, :len(words)] = True
    return list(index), ids, mask


def _hardest(net: Network, windows: list[list[str]], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document, the window that scores highest, and its logit."""
    words, ids, mask = _indexed(windows)
    pre = net.gates_in(net.inputs(words))
    logits = np.concatenate([net.logits(pre, ids[at:at + BLOCK], mask[at:at + BLOCK]) for at in range(0, len(ids), BLOCK)])
    order = np.lexsort((logits, owners))
    best = order[np.r_[owners[order][1:] != owners[order][:-1], True]]
    return best, logits[best].astype(float)


def _calibrate(net: Network, logits: np.ndarray, labels: np.ndarray) -> None:
    """Scale and shift the logits to the likeliest probabilities of the labels, each label smoothed by one example."""
    many, few = labels.sum(), len(labels) - labels.sum()
    wanted = np.where(labels > 0, (many + 1) / (many + 2), 1 / (few + 2))
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = np.clip(_sigmoid(x @ w), 1e-9, 1 - 1e-9)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(curve, x.T @ (p - wanted)), -1, 1)
    if w[0] > 0:
        net.p["out"] *= np.float32(w[0])
        net.p["bias"] = (net.p["bias"] * w[0] + w[1]).astype(np.float32)


def fit(
    windows: list[list[str]], labels: list[int], owners: list[int], steps: int = 120, hard: int = 60, size: int = 256,
    rate: float = 0.01, vocabulary: int = VOCABULARY, net: Network | None = None,
) -> Network:
    """Train by Adam on windows that carry the label of their document; go on with ``net`` where given.

    Most windows of a toxic document are harmless, so at least ``steps`` steps over all windows come first; in the
    ``hard`` steps after them each document is represented by the window that scores highest at the time, as it will be
    when it is scored.
    """
    owner, target = np.array(owners, np.int64), np.array(labels, np.float32)
    if net is None:
        counts = Counter(w for window in windows for w in set(window))
        known = sorted((w for w, n in counts.items() if n > 2), key=lambda w: (-counts[w], w))[:vocabulary]
        prior = float(target[np.unique(owner, return_index=True)[1]].mean()) if labels else 0.0
        net = Network.fresh({w: i + 1 for i, w in enumerate(known)}, prior)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    draw, step = np.random.default_rng(1), 0
    while step < steps + hard:
        order = draw.permutation(len(windows) if step < steps else _hardest(net, windows, owner)[0])
        for at in range(0, len(order), size):
            chosen = order[at:at + size]
            gradients = net.gradients(*_indexed([windows[i] for i in chosen]), target[chosen])
            step += 1
            for k, d in gradients.items():
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                away = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                net.p[k] -= np.float32(rate) * away
    return net


class Scorer:
    """Scores whole texts; keeps the gate inputs of a bounded number of words."""

    def __init__(self, net: Network):
        self.net = net
        self._forget(MEMORY)

    def _forget(self, room: int) -> None:
        self.index: dict[str, int] = {}
        self.pre = tuple(np.empty((room, 3 * UNITS), np.float32) for _ in "fb")

    def _learn(self, words: list[str]) -> None:
        fresh = [w for w in dict.fromkeys(words) if w not in self.index]
        if len(self.index) + len(fresh) > len(self.pre[0]):
            fresh = list(dict.fromkeys(words))
            self._forget(max(MEMORY, len(fresh)))
        if fresh:
            first = len(self.index)
            for own, new in zip(self.pre, self.net.gates_in(self.net.inputs(fresh))):
                own[first:first + len(fresh)] = new
            self.index.update(zip(fresh, range(first, first + len(fresh))))

    def windows(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, start and logit of every window of the texts, given as lists of words."""
        flat = [w for words in found for w in words]
        if not flat or not self.net.p:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self._learn(flat)
        ids = np.array(list(map(self.index.__getitem__, flat)), dtype=np.int64)
        starts, owner, sizes, base = [], [], [], []
        for i, words in enumerate(found):
            mine = window_starts(len(words))
            starts.extend(mine)
            owner.extend([i] * len(mine))
            sizes.extend([min(LENGTH, len(words))] * len(mine))
            base.append(len(words))
        starts, owner, sizes = np.array(starts), np.array(owner), np.array(sizes)
        places_of = (np.cumsum(base) - base)[owner] + starts
        logits = np.empty(len(starts))
        for whole in (True, False):
            some = np.flatnonzero((sizes == LENGTH) == whole)
            for at in range(0, len(some), BLOCK):
                part = some[at:at + BLOCK]
                mask = np.arange(LENGTH) < sizes[part, None]
                places = np.where(mask, places_of[part, None] + np.arange(LENGTH), 0)
                logits[part] = self.net.logits(self.pre, ids[places], mask)
        return owner, starts, logits

    def score(self, texts: list[str]) -> np.ndarray:
        """The highest probability over all windows of each text; the share of label 1 for a text without words."""
        owner, _, logits = self.windows([tokens(t) for t in texts])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logits)
        scores = 1.0 / (1.0 + np.exp(-np.clip(best.astype(float), -50, 50)))
        return np.where(np.isfinite(best), scores, self.net.prior)


WINDOW = "id long, label int, start int, words string, logit double"


def _windows(most: int, net: Network | None):
    """At most ``most`` windows of each text: drawn with the document's id as the seed, or, given a network, those of all
    its windows that score highest, the highest first."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in batches:
            rows = []
            for ident, label, text in zip(*[c.to_pylist() for c in batch.columns]):
                words = tokens(text)
                starts = list(window_starts(len(words)))
                if scorer:
                    _, places, logits = scorer.windows([words])
                    chosen = [(int(places[i]), float(logits[i])) for i in np.lexsort((places, -logits))[:most]]
                else:
                    chosen = [(s, 0.0) for s in sorted(random.Random(ident).sample(starts, min(most, len(starts))))]
                rows.extend((ident, label, s, " ".join(words[s:s + LENGTH]), logit) for s, logit in chosen)
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "label", "start", "words", "logit"])

    return run


def _taught(rows: list, **options) -> Network:
    ordered = sorted(rows)
    words = [list(map(sys.intern, r.words.split(" "))) for r in ordered]
    return fit(words, [r.label for r in ordered], [r.id for r in ordered], **options)


def train(
    docs: DataFrame, labels: DataFrame, positive: int = 1500, negative: int = 3000, windows: int = 16, vocabulary: int = VOCABULARY
) -> Network:
    """Learn from at most so many labelled documents of each kind, chosen by hash.

    Only rows that are not held out teach. Training begins with ``windows`` drawn windows of each document, which all
    carry its label. The network then scores every window of the whole texts, on the executors; it goes on with the
    ``windows`` that score highest in each, and at last scale and shift are fitted to the highest window of all of each
    document, which is what a score is. So texts of any length count whole, and the driver gets a bounded number of words.

    A text of a sampled id counts once, the first by order where rows share the id. Null texts, ids without a text and
    other columns, whatever their names, are not looked at. Without labelled rows the network has no weights and gives
    every text the score 0.
    """
    texts = docs.select("doc_id", "text").where("text is not null")
    usable = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label")).distinct()
    known = usable.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("label = 1").orderBy(*order).limit(positive).union(
        known.where("label = 0").orderBy(*order).limit(negative)
    )
    met = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = stored(met.select("doc_id", F.col("label").cast("int").alias("label"), "text"), "labelled")

    def cut(most: int, net: Network | None) -> list:
        return sample.mapInArrow(_windows(most, net), WINDOW).collect()

    drawn = cut(windows, None)
    if not drawn:
        return Network({})
    net = _taught(drawn, vocabulary=vocabulary)
    net = _taught(cut(windows, net), steps=0, hard=100, rate=0.005, net=net)
    highest = sorted((r.id, r.label, r.logit) for r in cut(1, net))
    _calibrate(net, np.array([r[2] for r in highest]), np.array([r[1] for r in highest], np.float32))
    return net


SCHEMA = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _scoring(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            parts = [scorer.score(texts[at:at + 100]) for at in range(0, len(texts), 100)]
            scores = np.concatenate(parts) if parts else np.empty(0)
            predicted = (scores >= 0.5).astype(np.int32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores), pa.array(predicted)], schema=SCHEMA)

    return run


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``, from its whole text alone.

    ``score`` is the highest probability of label 1 over all overlapping windows of the text. Null, empty and wordless
    texts get the share of label 1 in training. Rows that share an id are scored apart; an empty table gives no rows.
    """
    ident = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(ident.alias("id"), held_out(ident).alias("held_out"), text.alias("text"))
    fields = "id long, held_out boolean, score double, predicted int"
    return rows.mapInArrow(_scoring(net), fields).withColumnRenamed("id", id_col)
