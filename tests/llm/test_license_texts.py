"""Headers, passages inside lines and whole licence texts; nothing is skipped without proof."""

import math
import random

import pytest

from netweir.llm import license_scan as ls
from netweir.llm.common import stored

MATCHER = ls.Matcher(1000, {t: 900 for t in ("the", "of", "to", "and", "a", "in", "is", "this", "under")})


@pytest.mark.parametrize("name,text", ls.FULL_TEXTS)
def test_full_texts(name, text):
    license_, cosine, line, _, whole = MATCHER.read("Copyright 2020 Somebody Else\n" + text)
    assert license_ == name and line is None and whole >= ls.FULL


@pytest.mark.parametrize("text,name", [
    ("# SPDX-License-Identifier: MIT\nint x;", "MIT"), ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("Licensed under GPL-3.0", "GPL-3.0"),
    ("Released under MIT.", "MIT"), ("A tool for many small things that we wrote over years of rain. Released under the MIT License.", "MIT"),
    ("Permission is hereby granted, free of charge,\nto any person obtaining\na copy of this software", "MIT"),
    (dict(ls.FULL_TEXTS)["MIT"].replace("\n", " ") + "\n" + "code " * 2000, "MIT"), ("SPDX-License-Identifier: Foo-9.9", None), ("We drove under the bridge.", None),
])
def test_headers_and_passages(text, name):
    assert MATCHER.read(text)[0] == name


def test_licence_file_hands_down(spark):
    files = {"p/LICENSE": dict(ls.FULL_TEXTS)["MIT"], "p/x.c": "int main", "q/a.c": "Released under MIT.", "q/b.c": "code"}
    df = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(files.items())], "doc_id long, path string, text string")
    got = {r.path: (r.license, r.origin) for r in ls.licenses(stored(ls.scan(df), "scanned")).collect()}
    assert got == {"p/LICENSE": ("MIT", "notice"), "p/x.c": ("MIT", "inherited"), "q/a.c": ("MIT", "notice"), "q/b.c": ("MIT", "inherited")}


def test_bound_skips_no_line():
    """Every line against every notice, without any prefilter."""
    rnd = random.Random(4)
    for _ in range(400):
        words = ls.terms(rnd.choice(ls.TEMPLATES)[1]) + rnd.choices(["rain", "road", "the", "mit"], k=rnd.randint(0, 3))
        line = " ".join(rnd.sample(words, rnd.randint(1, len(words))))
        v, best = MATCHER.vector(ls.terms(line)), 0.0
        for _, text in ls.TEMPLATES:
            w = MATCHER.vector(ls.terms(text))
            best = max(best, sum(x * w.get(t, 0) for t, x in v.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values())))
        assert (MATCHER.read(line)[1] >= best - 1e-9) if best >= ls.LEAST else True
