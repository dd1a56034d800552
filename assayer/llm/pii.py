"""Personal data by anchor expansion: an automaton finds cues, local parsers find and check the bounds around them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "spelled_email", "login", "iban", "account", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# what may follow an anchor, matched at that place only
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
SPELLED = re.compile(r"\x20?([A-Za-z0-9-]+)(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]+)+")
LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[\s:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|number)\b)?[.\s:#]{1,4}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.IGNORECASE)
SECRET = re.compile(r"[\"']?[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?([A-Za-z0-9_+/=.~-]{8,256})(?![A-Za-z0-9_+/=.~-])")
CUES = {"(at)": "spelled", "[at]": "spelled", "://": "scheme"} | {
    form: cue
    for word, cue in {
        "iban": "iban", "account": "account", "acct": "account", "konto": "account",
        "token": "secret", "key": "secret", "secret": "secret", "password": "secret", "passwd": "secret",
    }.items()
    for form in (word, word.capitalize(), word.upper())
}


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for cue, kind in {"@": "at", "+": "plus", **{d: "digit" for d in "0123456789"}, **CUES}.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid_iban(text: str) -> bool:
    moved = text[4:] + text[:4]
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _local_start(text: str, at: int, least: int) -> int:
    """Where the local part that ends before ``at`` begins."""
    while at > least and text[at - 1] in LOCAL:
        at -= 1
    return at


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data in ``text``, by kind in the order of KINDS, then by start.

    The base kinds equal their patterns, matched leftmost and without overlap within a kind, a match that fails its
    check being passed over whole. Each cue is met once, from left to right, and no text is read twice for a kind:
    a cue inside what the kind has passed is skipped.
    """
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys((*KINDS, "run"), 0)

    def keep(kind: str, start: int, end: int, good: bool) -> None:
        done[kind] = end
        if good:
            spans[kind].append((start, end))

    for last, (cue, size) in automaton().iter(text):
        at, after = last - size + 1, last + 1
        if cue == "digit":
            if at >= done["run"]:
                done["run"] = DIGITS.match(text, at).end()
                if at >= done["ip"] and text.startswith(".", done["run"]) and (m := QUAD.match(text, at)):
                    parts = [p.lstrip("0") for p in m.groups()]
                    keep("ip", at, m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts))
            if at >= done["card"] and (m := CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                keep("card", at, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
        elif cue == "at":
            start = _local_start(text, at, done["email"])
            if start < at and (m := DOMAIN.match(text, after)):
                keep("email", start, m.end(), True)
        elif cue == "plus":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                keep("phone", at, m.end(), 9 <= sum(c.isdigit() for c in m[0]) <= 15)
        elif cue == "spelled":
            before = at - text.startswith(" ", at - 1) if at else at
            start = _local_start(text, before, done["spelled_email"])
            if start < before and (m := SPELLED.match(text, after)):
                keep("spelled_email", start, m.end(), True)
        elif cue == "scheme":
            if after >= done["login"] and (m := LOGIN.match(text, after)):
                keep("login", after, m.end(), True)
        elif cue == "iban":
            if m := IBAN.match(text, after):
                _longest_iban(m, keep)
        elif cue == "secret":
            if (m := SECRET.match(text, after)) and m.start(1) >= done["secret"]:
                keep("secret", m.start(1), m.end(1), not text[at - 1:at].isalnum() and any(c.isdigit() for c in m[1]))
        elif (m := ACCOUNT.match(text, after)) and m.start(1) >= done["account"]:
            keep("account", m.start(1), m.end(1), True)
    return [(kind, *span) for kind in KINDS for span in spans[kind]]


def _longest_iban(m: re.Match, keep) -> None:
    """Words after the number may look like part of it: the longest start that passes the check digits counts."""
    for end in range(m.end(1), m.start(1) + 14, -1):
        number = m.string[m.start(1):end].replace(" ", "")
        if m.string[end - 1] != " " and valid_iban(number):
            return keep("iban", m.start(1), end, True)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


SCHEMA = pa.schema([
    ("id", pa.int64()), *[(f"n_{kind}", pa.int64()) for kind in BASE], ("base_sha256", pa.string()), ("spans", pa.string()),
])


def _searching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = find(text)
            base = [s for s in spans if s[0] in BASE]
            counts = [sum(s[0] == kind for s in base) for kind in BASE]
            rows.append((i, *counts, sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        columns = zip(*rows) if rows else [[] for _ in SCHEMA]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``.

    Counts and digest cover the base kinds; ``spans`` has all kinds as kind:start:end in code points, end exclusive.
    A secret is the value, of 8 to 256 characters with a digit among them, that a word like token, key or password is
    given by a colon or an equals sign. Null is read as the empty text, which has no spans: counts 0, an empty list and its digest. Rows that share an id
    are searched apart; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(_searching, fields).withColumnRenamed("id", id_col)
