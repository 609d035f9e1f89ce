"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from directories.

Lines, windows of terms (as many as a template has, over line breaks or inside a line) and whole
files are compared with notices, headers and full licence texts by the cosine of their TF-IDF
vectors. cosine <= |the template's shared terms| / |template|, so a template whose terms in the
text weigh too little for the limit is skipped without loss. A file that as a whole is near a full
text, or whose lines are notices for the most part, is the licence file of its directory. Files without a notice of their own
inherit from the nearest directory above them that has a licence file.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
LEAST = 0.7  # cosine from which a line is a notice
FULL = 0.85  # cosine of a whole file to a full text from which it is a licence file
FILE_SHARE = 0.5  # share of a file's lines that are notices, from which it is a licence file
#: Notices of common licences (fixed values).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "This software is released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "This software is released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def terms(line: str) -> list[str]:
    return TERM.findall(line.lower())


#: Full texts; a text that isn't there (AGPL, CC BY) is known by its notices only.
FULL_NAMES = (
    "Apache-2.0 Artistic-1.0 BSD-2-Clause BSD-3-Clause CC0-1.0 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 MIT MPL-1.1 MPL-2.0 Unlicense"
).split()
FULL_TEXTS = [(name, pkgutil.get_data(__name__, f"license_texts/{name}.txt").decode()) for name in FULL_NAMES]
#: Headers that name a licence by its identifier: they match only with all terms of the identifier.
IDENTIFIERS = sorted({name for name, _ in TEMPLATES} | set(FULL_NAMES))
HEADERS = [
    (name, form.format(i))
    for name in IDENTIFIERS
    for i in ([name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name])
    for form in ("SPDX-License-Identifier: {}", "Licensed under {}", "Licensed under the {} license", "Released under the {} license", "License: {}", "{} License")
]
WINDOW = 4  # least number of terms of a template that is also looked for inside lines
VOCABULARY = frozenset(t for _, text in [*TEMPLATES, *HEADERS, *FULL_TEXTS] for t in terms(text))


def document_counts(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of documents that hold each template term (a bounded list)."""

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found[""] += 1
                if text:
                    found.update(VOCABULARY.intersection(terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r["term"]: r["n"] for r in counts.collect()}  # one row per template term
    return got.pop("", 0), got


class Matcher:
    def __init__(self, documents: int, counts: dict[str, int]):
        self.rarest = math.log((1 + documents) / 1) + 1
        self.idf = {t: math.log((1 + documents) / (1 + counts.get(t, 0))) + 1 for t in VOCABULARY}
        self.templates = []
        for name, text in TEMPLATES:
            v = self.vector(terms(text))
            self.templates.append((name, v, math.sqrt(sum(x * x for x in v.values()))))
        short = [(n, terms(x), frozenset()) for n, x in TEMPLATES] + [(n, terms(x), frozenset(terms(n))) for n, x in HEADERS]
        self.short = [(n, w, self.vector(w), needed) for n, w, needed in short]
        self.full = [(n, self.vector(terms(x))) for n, x in FULL_TEXTS]
        # Squared weight of each term (row) in each template (column), and what a match needs of it.
        self.row = {t: k for k, t in enumerate(sorted(VOCABULARY))}
        vectors = [v for _, _, v, _ in self.short] + [v for _, v in self.full]
        self.squares = np.zeros((len(self.row), len(vectors)))
        for k, v in enumerate(vectors):
            for t, x in v.items():
                self.squares[self.row[t], k] = x * x
        self.norms = np.sqrt(self.squares.sum(0))
        least = np.array([LEAST] * len(self.short) + [FULL] * len(self.full))
        self.needed = self.squares.sum(0) * least**2 - 1e-9
        # Templates by term, so that a line only meets those it shares a term with.
        self.holders: dict[str, list[int]] = {}
        for k, (_, v, _) in enumerate(self.templates):
            for t in v:
                self.holders.setdefault(t, []).append(k)

    def vector(self, words: list[str]) -> dict[str, float]:
        return {t: n * self.idf.get(t, self.rarest) for t, n in Counter(words).items()}

    def best(self, line: str) -> tuple[str | None, float]:
        """The template closest to a line (the first of equals) and the cosine."""
        words = terms(line)
        v = self.vector(words)
        dots: dict[int, float] = {}
        for t, x in v.items():
            for k in self.holders.get(t, ()):
                dots[k] = dots.get(k, 0.0) + x * self.templates[k][1][t]
        if not dots:
            return None, 0.0
        norm = math.sqrt(sum(x * x for x in v.values()))
        k = min(dots, key=lambda k: (-dots[k] / self.templates[k][2], k))
        return self.templates[k][0], dots[k] / self.templates[k][2] / norm


    def possible(self, words) -> np.ndarray:
        """The templates (short ones, then full texts) that the terms may come near."""
        rows = [self.row[t] for t in VOCABULARY.intersection(words)]
        return np.flatnonzero(self.squares[rows].sum(0) >= self.needed)

    def cosine(self, v: dict[str, float], k: int) -> float:
        other = self.short[k][2] if k < len(self.short) else self.full[k - len(self.short)][1]
        dot = sum(x * v[t] for t, x in other.items() if t in v)
        return dot / self.norms[k] / math.sqrt(sum(x * x for x in v.values())) if dot else 0.0

    def read(self, text: str | None) -> tuple[str | None, float, int | None, float, float]:
        """License, similarity and line (None: the whole file) of the best match, share of the
        lines that are notices, cosine of the file to the nearest full text (0 below FULL)."""
        words = terms(text) if text else []
        able = self.possible(words)
        if not len(able):
            return None, 0.0, None, 0.0, 0.0
        n = len(self.short)
        lines, at, best, hits, filled = [], [], (None, 0.0, None), 0, 0
        for k, line in enumerate(text.split("\n")):
            own = terms(line)
            lines += own
            at += [k] * len(own)
            if not line.strip():
                continue
            filled += 1
            name, cosine = None, 0.0
            near = [i for i in self.possible(own) if i < n]
            if near:
                name, cosine = self.best(line)
                v = self.vector(own)
                for i in near:
                    if self.short[i][3] and self.short[i][3] <= v.keys() and (c := self.cosine(v, i)) > cosine + 1e-9:
                        name, cosine = self.short[i][0], c
            if cosine >= LEAST:
                hits += 1
                if cosine > best[1]:
                    best = (name, cosine, k)
        places: dict[str, list[int]] = {}
        for k, t in enumerate(lines):
            if t in self.row:
                places.setdefault(t, []).append(k)
        for i in able[able < n]:
            name, own, weights, needed = self.short[i]
            if len(own) < WINDOW:
                continue
            for k in sorted({k for t in weights for k in places.get(t, ())}):
                window = lines[k : k + len(own)]
                have = set(window)
                if not needed <= have or sum(weights[t] ** 2 for t in have if t in weights) < self.needed[i]:
                    continue
                c = self.cosine(self.vector(window), i)
                if c >= LEAST and c > best[1] + 1e-9:
                    best = (name, c, at[k])
        v, whole, full = self.vector(words), 0.0, None
        for i in able[able >= n]:
            c = self.cosine(v, i)
            if c >= FULL and c > whole:
                full, whole = self.full[i - n][0], c
        # The GPL of version 3 and the AGPL differ in a few words: the title decides.
        if full == "GPL-3.0" and lines[:4] == ["gnu", "affero", "general", "public"]:
            full = "AGPL-3.0"
        if full is not None:
            best = (full, whole, None)
        return *best, hits / max(1, filled), whole


#: Words that most notices hold. Nothing is skipped by them.
ANCHOR = re.compile(r"licen[sc]e|domain|redistribution|permission|\bcc", re.I)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, path, license (closest notice of the text, null if none), similarity, line (its
    number, from 0; null if the whole file is a full text), share (of the non-empty lines that are
    notices), whole (cosine to the nearest full text, 0 below FULL). Ties: the first line."""
    matcher = Matcher(*document_counts(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("license", pa.string()), ("similarity", pa.float64()), ("line", pa.int64()), ("share", pa.float64()), ("whole", pa.float64())])

    def run(batches):
        for batch in batches:
            rows = tuple([] for _ in schema.names)
            for doc_id, path, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "path", "text"))):
                for column, x in zip(rows, (doc_id, path, *matcher.read(text))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, path string, license string, similarity double, line long, share double, whole double")


def licenses(scanned: DataFrame) -> DataFrame:
    """The licence of every file: doc_id, path, license, origin ('notice', 'inherited' or
    'none'), similarity, license_dir (where an inherited licence comes from).

    ``scanned`` is a stored table of ``scan``. A directory with several licence files has the
    licence of most of them, of equals the first by name. Null paths, and files no directory of
    which has a licence file, have none. Every row of the table stays, repeated ones too.
    """
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    files = scanned.withColumn("dir", folder)
    votes = files.filter(F.col("license").isNotNull() & ((F.col("share") >= FILE_SHARE) | (F.col("whole") >= FULL)) & F.col("dir").isNotNull()).groupBy("dir", "license").count()
    owned = votes.groupBy("dir").agg(F.min(F.struct((-F.col("count")).alias("votes"), "license")).alias("top")).select(F.col("dir").alias("above"), F.col("top.license").alias("inherited"))
    # Each directory once, with all directories above it; deeper ones have longer names.
    dirs = files.filter(F.col("license").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    nearest = (
        dirs.select("dir", F.explode(F.array_distinct(above)).alias("above")).join(owned, "above")
        .groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "inherited")).alias("top")).select("dir", "top.above", "top.inherited")
    )
    out = files.join(nearest, "dir", "left")
    own = F.col("license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("license", "inherited").alias("license"),
        F.when(own, "notice").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        "similarity", F.when(~own, F.col("above")).alias("license_dir"),
    )
