import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from netweir.llm import stripes
from netweir.llm.stripes import divergences
from netweir.llm.terms import term_bytes

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows):
    rows = [(lang or "", source or "", terms(text)) for lang, source, text in rows]
    groups, df, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in rows:
        groups[lang].add(source)
        df[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= 10]
        p = {}
        for s in sources:
            total = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total + 2 * len(kept)) for t in kept}
        both = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (both[t] + 2) // (sum(both.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            best = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, 10)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found)}
    return out


def corpus(n=400, seed=3):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdéfgh" for b in "xyZ中"]
    rows = []
    for i in range(n):
        lang = rnd.choice(["en", "en", "en", "de", None])
        source = "hot" if rnd.random() < 0.4 else f"s{rnd.randint(0, 5)}"
        rows.append((lang, source, " ".join(rnd.choices(words[: rnd.randint(3, len(words))], k=rnd.randint(0, 30)))))
    return rows + [("xx", "a", "few words"), ("xx", None, ""), ("yy", "alone", None), ("yy", "alone", "aa " * 5)]


DDL = "lang string, source string, text string"


def test_same_as_plain_counts(spark):
    rows = corpus()
    got = [tuple(r) for r in divergences(spark.createDataFrame(rows, DDL).repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_many_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(stripes, "BUCKET", 20)  # read on the driver
    rows = corpus(300, 8)
    assert {tuple(r) for r in divergences(spark.createDataFrame(rows, DDL).repartition(3)).collect()} == brute(rows)


def test_blocks_of_sources(spark):
    rows = [("en", f"s{i:03}", f"common word w{i % 20} w{i % 7}") for i in range(300)]
    assert {tuple(r) for r in divergences(spark.createDataFrame(rows, DDL)).collect()} == brute(rows)


def test_stripes_handed_on_early_merge_to_the_same():
    rows, inside = corpus(200, 5), term_bytes(False)
    whole, pieces = stripes.Fold(), []
    for k in range(0, len(rows), 9):
        columns = [pa.array([r[c] or "" for r in rows[k : k + 9]]) for c in range(3)]
        whole.add(*columns, inside)
        piece = stripes.Fold()
        piece.add(*columns, inside)
        pieces += piece.batches()
    table = pa.Table.from_batches(pieces).sort_by([("lang", "ascending"), ("term", "ascending")])
    plain = lambda batches: sorted((r["lang"], r["term"], r["df"], sorted(zip(r["sources"], r["counts"]))) for b in batches for r in b.to_pylist())
    one = plain(whole.batches())
    assert plain(stripes._merged(iter(table.combine_chunks().to_batches(7)))) == one
    assert len(one) == len({r[:2] for r in one})


def test_chance_is_exact():
    rnd = random.Random(1)
    for _ in range(2000):
        size = rnd.randint(2, 10 ** rnd.randint(1, 17))
        count = rnd.randint(0, size - 2)
        assert int(stripes.chance(np.array([count]), np.array([size]))[0]) == 1 + 10**9 * (count + 2) // size


def test_edges(spark):
    none = spark.createDataFrame([], DDL)
    assert divergences(none).collect() == []
    rows = [(None, None, None), ("en", "a", ""), ("en", "b", "word " * 50_000)] + [("en", "a", "word tie one")] * 12 + [("en", "b", "one two tie")] * 11
    clash = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], DDL + ", term int, n long, bucket string, df int")
    assert {tuple(r) for r in divergences(clash).collect()} == brute(rows)
