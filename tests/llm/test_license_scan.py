import math
import re
from collections import Counter

import pytest

from netweir.llm import license_scan as ls
from netweir.llm.common import stored


def brute(files):
    """files: {path: text}. (license, origin, license_dir) per path, all lines against all templates."""
    n = len(files)
    held = Counter(t for x in files.values() for t in set(ls.terms(x or "")))

    def vector(text):
        return {t: c * (math.log((1 + n) / (1 + (held[t] if t in ls.VOCABULARY else 0))) + 1) for t, c in Counter(ls.terms(text)).items()}

    def cosine(x, y):
        dot = sum(v * y.get(t, 0) for t, v in x.items())
        return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if dot else 0.0

    own, votes = {}, {}
    for path, text in files.items():
        found = []
        lines = [x for x in (text or "").split("\n") if x.strip()]
        for line in lines:
            if ls.ANCHOR.search(line):
                c, k = max((cosine(vector(line), vector(t)), -k) for k, (_, t) in enumerate(ls.TEMPLATES))
                if c >= ls.LEAST:
                    found.append((c, ls.TEMPLATES[-k][0]))
        own[path] = max(found, key=lambda x: x[0])[1] if found else None
        if found and len(found) >= ls.FILE_SHARE * len(lines):
            votes.setdefault(path.rpartition("/")[0], Counter())[own[path]] += 1
    out = {}
    for path in files:
        folder, origin = path, ("notice" if own[path] else "none")
        license_, where = own[path], None
        while origin == "none" and folder:
            folder = folder.rpartition("/")[0]
            if folder in votes:
                license_, origin, where = min(votes[folder].items(), key=lambda x: (-x[1], x[0]))[0], "inherited", folder
        out[path] = (license_, origin, where)
    return out


FILES = {
    "a/LICENSE": "Released under the MIT License.", "a/x.c": "int main", "a/b/y.c": "words of the text\nmore", "a/b/c/z.c": None, "a/b/c/LICENSE": "Licensed under the Apache License, Version 2.0.\nCopyright",
    "d/e/f.c": "This work is licensed under the GNU General Public License, version 3.\ncode\ncode\ncode", "d/e/g.c": "code", "h/LICENSE": "Licensed under CC BY-NC 4.0.", "h/LICENSE2": "Licensed under the MIT License.", "h/i.txt": "",
    "top": "nothing", "a/b/near.c": "licensed under the apache license version 2.0", "a/far.c": "the license of this road is a long word about driving in the rain with a licence",
}


def test_same_as_brute_force(spark):
    df = spark.createDataFrame([(k, p, t, "MIT") for k, (p, t) in enumerate(FILES.items())], "doc_id long, path string, text string, license string")
    got = {r.path: (r.license, r.origin, r.license_dir) for r in ls.licenses(stored(ls.scan(df), "scanned")).collect()}
    assert got == brute(FILES)
    assert got["a/x.c"] == ("MIT", "inherited", "a") and got["a/b/y.c"] == ("Apache-2.0", "inherited", "a/b") and got["h/i.txt"][0] == "CC-BY-NC-4.0"


def test_repeats_nulls_and_empty(spark):
    rows = [(1, None, "Released under the MIT License."), (1, None, "Released under the MIT License."), (2, "x/y", None), (None, "x/z", "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = sorted((str(r.doc_id), r.license, r.origin) for r in ls.licenses(stored(ls.scan(df), "scanned")).collect())
    assert got == [("1", "MIT", "notice"), ("1", "MIT", "notice"), ("2", None, "none"), ("None", None, "none")]
    none = spark.createDataFrame([], "doc_id long, path string, text string")
    assert ls.licenses(stored(ls.scan(none), "scanned")).collect() == []


@pytest.mark.parametrize("name,text", ls.TEMPLATES)
def test_templates_find_themselves(name, text):
    found, cosine = ls.Matcher(10, {}).best(text)
    assert cosine == pytest.approx(1) and re.sub(r"\W", "", found) == re.sub(r"\W", "", name)
