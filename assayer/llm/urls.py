"""URL filter: rules where they fit, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import ascii_lower

# fixed values: the filter's rules as (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BUCKETS = 1 << 15
ORDERS = (2, 3, 4)


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null and where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(tail, "^[^?#]*", 0)


def fitting_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; of equally long ones the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def buckets(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of host and path, the two kept apart; the ends are marked."""
    found = []
    for part, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        if len(text) == 2:
            continue
        for n in ORDERS:
            found.extend(zlib.crc32(f"{part}{text[i:i + n]}".encode(errors="replace")) for i in range(len(text) - n + 1))
    return np.array(found, dtype=np.int64) % BUCKETS


def train(rows: list[tuple[str, str, int]], rounds: int = 30, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """Fit by adaptive gradient steps over the rows in their order; no rows give a model that blocks nothing."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return Model(weights, -1.0)
    features = [buckets(h, p) for h, p, _ in rows]
    labels = np.array([y for *_, y in rows], dtype=float)
    owner = np.repeat(np.arange(len(rows)), [len(f) for f in features])
    flat = np.concatenate(features) if len(owner) else np.empty(0, np.int64)
    scale = 1.0 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(rows))))
    squares, bias_square = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(owner, weights[flat], minlength=len(rows)) * scale + bias
        error = 1.0 / (1.0 + np.exp(-z)) - labels
        slope = np.bincount(flat, (error * scale)[owner], minlength=BUCKETS) + decay * weights
        squares += slope**2
        weights -= rate * slope / np.sqrt(squares)
        bias_square += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(bias_square)
    return Model(weights, bias)


def score(model: Model, host: str, path: str) -> float:
    """Probability that the url belongs with those blocked."""
    f = buckets(host, path)
    z = model.bias + (model.weights[f].sum() / np.sqrt(len(f)) if len(f) else 0.0)
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))))


def labelled(parts: DataFrame, most: int) -> list[tuple[str, str, int]]:
    """The labelled table: up to ``most`` distinct urls that a rule decides, chosen and ordered by hash."""
    known = parts.where("rule_verdict is not null").select("host", "path", "rule_verdict").distinct()
    chosen = known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most)
    return [(r.host, r.path, int(r.rule_verdict == "block")) for r in chosen.collect()]


def _judging(model: Model):
    schema = pa.schema([("page_id", pa.int64()), *[(c, pa.string()) for c in ("host", "path", "rule", "verdict")],
                        ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, paths, rules, decided = [c.to_pylist() for c in batch.columns]
            scores = [None if v else score(model, h, p) for h, p, v in zip(hosts, paths, decided)]
            verdicts = [v or ("block" if s >= 0.5 and (h or p) else "allow") for v, s, h, p in
                        zip(decided, scores, hosts, paths)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in
                                   zip((ids, hosts, paths, rules, verdicts, scores), schema)], schema=schema)

    return run


def judge(pages: DataFrame, rules: tuple = RULES, train_urls: int = 4000) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of ``pages`` (page_id, url).

    A rule fits its host and all subdomains of it if the path starts with the rule's; the longest one that fits
    decides, and ``score`` is null. Other urls are judged by a regression trained on at most ``train_urls`` distinct
    urls that rules decide, so that what is like blocked urls is blocked: ``score`` is the probability of that. A null
    url, or one without ``://``, has empty host and path and is allowed. Repeated rows are judged apart and alike; an
    empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    parts = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))
    model = train(labelled(parts, train_urls))
    fields = "page_id long, host string, path string, rule string, verdict string, score double"
    return parts.mapInArrow(_judging(model), fields)
