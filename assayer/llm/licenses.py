"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from directories."""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import stored

# fixed values: what headers and licence files of common licences say
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in"
     " compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
     " associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
     " General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"
     " provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)
# whole texts of licence files, in licence_texts; of the CC BY licences there are only the notices above
FULL_TEXTS = (
    "Apache-2.0", "MIT", "GPL-3.0", "BSD-3-Clause", "MPL-2.0", "Unlicense", "Artistic-1.0-Perl", "CC0-1.0", "GFDL-1.2",
    "GFDL-1.3", "GPL-1.0", "GPL-2.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1",
)
# fixed values: what many licence files say beside their terms; it counts where nothing else fits
RESERVED = "Proprietary"
# fixed values: words too common to tell licences apart
COMMON = frozenset("a an and any are as at be by for from in is it may of on or that the this to under with you".split())
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"


def terms(text: str) -> list[str]:
    return [t for t in TERM.findall(text.lower()) if t not in COMMON]


class Templates:
    """TF-IDF vectors of length one, with the templates themselves as the corpus of the weights."""

    def __init__(self, templates=TEMPLATES):
        listed = [(name, Counter(terms(text))) for name, text in templates]
        seen = Counter(t for _, counts in listed for t in counts)
        self.unknown = math.log(1 + len(listed)) + 1
        self.weight = {t: math.log((1 + len(listed)) / (1 + n)) + 1 for t, n in seen.items()}
        self.names = [name for name, _ in listed]
        self.kinds = [[i for i, n in enumerate(self.names) if (n == RESERVED) == reserved] for reserved in (False, True)]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.sizes = [sum(counts.values()) for _, counts in listed]
        self.offsets: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(templates):
            for offset, t in enumerate(terms(text)):
                self.offsets.setdefault(t, []).append((i, offset))
        for i, (_, counts) in enumerate(listed):
            length = math.sqrt(sum((n * self.weight[t]) ** 2 for t, n in counts.items()))
            for t, n in counts.items():
                self.postings.setdefault(t, []).append((i, n * self.weight[t] / length))

    def places(self, found: list[str]) -> list[tuple[int, int]]:
        """(start, end) of the stretches of a template's size where at least half of its terms stand as in it, and three
        at least: each term that a template has says where the template would begin, and these votes are counted."""
        votes = Counter((i, at - offset) for at, t in enumerate(found) for i, offset in self.offsets.get(t, ()))
        enough = [max(min(3, size), -(-size // 2)) for size in self.sizes]
        return sorted({(max(0, start), start + self.sizes[i]) for (i, start), n in votes.items() if n >= enough[i]})

    def best(self, found: list[str]) -> tuple[float, str | None]:
        """Highest cosine over the templates and its licence, the first listed of equal ones."""
        return max(self.split(found), key=lambda m: m[0])

    def split(self, found: list[str]) -> tuple[tuple[float, str | None], tuple[float, str | None]]:
        """The best match among all templates but those of ``RESERVED``, and the best among these."""
        if self.postings.keys().isdisjoint(found):
            return (0.0, None), (0.0, None)
        counts = Counter(found)
        length = math.sqrt(sum((n * self.weight.get(t, self.unknown)) ** 2 for t, n in counts.items()))
        dots = [0.0] * len(self.names)
        for t, n in counts.items():
            for i, w in self.postings.get(t, ()):
                dots[i] += n * self.weight[t] * w
        tops = [max(own, key=lambda i: (dots[i], -i), default=None) for own in self.kinds]
        return tuple((0.0, None) if i is None or not dots[i] else (dots[i] / length, self.names[i]) for i in tops)


@cache
def _standard() -> Templates:
    return Templates()


def full_text(name: str) -> str:
    return pkgutil.get_data("assayer.llm", f"licence_texts/{name}.txt").decode()


@cache
def _full() -> Templates:
    return Templates([(name, full_text(name)) for name in FULL_TEXTS])


Match = tuple[float, str | None]


def scan(text: str, templates: Templates, full: Templates) -> tuple[Match, Match, Match, Match, Match]:
    """Best match of the text as a whole with a whole licence text; then with a notice, and of any of its lines, runs of
    lines between blank ones, or stretches of a notice's size where its terms stand in order, wherever lines break; each
    time first without and then of ``RESERVED`` alone."""
    whole, lines, block = [], [], []
    for line in [*text.split("\n"), ""]:
        found = terms(line)
        if found:
            whole += found
            block += found
            lines.append(templates.split(found))
        else:
            if block and len(lines) > 1:
                lines.append(templates.split(block))
            block = []
    if not templates.postings.keys().isdisjoint(whole):
        lines.extend(templates.split(whole[start:end]) for start, end in templates.places(whole))
    headers = [max((pair[i] for pair in lines), key=lambda m: m[0], default=(0.0, None)) for i in range(2)]
    return full.best(whole), *templates.split(whole), *headers


MATCHES = ("full", "file", "reserved_file", "header", "reserved_header")
SCHEMA = pa.schema([("id", pa.int64()), ("path", pa.string())] + [
    field for m in MATCHES for field in ((f"{m}_score", pa.float64()), (f"{m}_licence", pa.string()))
])


def _scanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, paths, texts = [c.to_pylist() for c in batch.columns]
        found = [[x for match in scan(t, _standard(), _full()) for x in match] for t in texts]
        columns = [ids, paths, *(zip(*found) if found else [[]] * (2 * len(MATCHES)))]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def directory(path: Column) -> Column:
    """All before the last slash; the empty text for the root and for paths without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The folder itself and all above it, the root (the empty text) last, with their depths."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    depths = F.sequence(F.lit(0), F.size(parts))
    return F.transform(depths, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("above")))


def licences(files: DataFrame, similar: float = 0.6, id_col: str = "doc_id") -> DataFrame:
    """(id, path, own_licence, own_score, own_kind, licence, inherited_from) for each row of ``files`` (id, path, text).

    A file is a licence file if its whole text has cosine ``similar`` or more with a whole licence text or a notice, or
    half of that with a notice where its name says so; it licenses itself and its directory. Any other file has the
    licence of the best of its headers (a line, a run of lines between blank ones, or a stretch of a notice's size inside
    longer ones) at ``similar`` or more. That all
    rights are reserved counts only in files where nothing else fits. Files with neither take that of the nearest
    directory above them that has a licence file; ``inherited_from`` names it, "" being the root. Of several licence
    files in a directory the one with the highest score counts, then the first path.

    Directories are joined by their paths, once for each directory and not for each file, so the join grows with the
    tree. Null texts count as empty and have no licence of their own. A null path lies in no directory and inherits
    nothing. Rows that share an id are scanned apart; an empty table gives no rows.
    """
    ident = F.col(id_col).cast("long").alias("id")
    scanned = files.select(ident, "path", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(
        _scanning, "id long, path string, " + ", ".join(f"{m}_score double, {m}_licence string" for m in MATCHES)
    )
    named = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAMES), F.lit(False))
    least = F.when(named, similar / 2).otherwise(similar)
    needed = {"full": F.lit(similar), "file": least, "header": F.lit(similar), "reserved_file": least,
              "reserved_header": F.lit(similar)}

    def pick(value: Callable[[str], Column]) -> Column:
        """The value of the first kind of match that is close enough."""
        fits = [F.when(F.col(f"{m}_licence").isNotNull() & (F.col(f"{m}_score") >= n), value(m)) for m, n in needed.items()]
        return F.coalesce(*fits)

    own = stored(
        scanned.select(
            "id", "path", directory(F.col("path")).alias("folder"),
            pick(lambda m: F.col(f"{m}_licence")).alias("own_licence"),
            pick(lambda m: F.col(f"{m}_score")).alias("own_score"),
            pick(lambda m: F.lit("header" if "header" in m else "file")).alias("own_kind"),
        ),
        "own-licences",
    )
    strongest = F.min(F.struct((-F.col("own_score")).alias("below"), "path", "own_licence")).alias("best")
    holders = own.where("own_kind = 'file' and path is not null").groupBy("folder").agg(strongest)
    holders = stored(holders.select(F.col("folder").alias("holder"), F.col("best.own_licence").alias("licence")), "holders")
    folders = own.where("path is not null").select("folder").distinct()
    above = folders.select("folder", F.inline(ancestors(F.col("folder")))).join(holders, F.col("above") == F.col("holder"))
    nearest = above.groupBy("folder").agg(F.max(F.struct("depth", "holder", "licence")).alias("near"))
    nearest = stored(nearest.select("folder", "near.holder", "near.licence"), "nearest")
    met = own.join(nearest, "folder", "left")
    inherits = F.col("own_licence").isNull() & F.col("path").isNotNull()
    return met.select(
        F.col("id").alias(id_col), "path", "own_licence", "own_score", "own_kind",
        F.coalesce("own_licence", F.when(inherits, F.col("licence"))).alias("licence"),
        F.when(inherits, F.col("holder")).alias("inherited_from"),
    )
