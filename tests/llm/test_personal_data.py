import hashlib
import random
import re

import numpy as np
import pytest

from netweir.llm import personal_data as pii
from netweir.llm.personal_data import KINDS, personal_data
from netweir.llm.queries import QUERIES


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    """Base spans by the stated patterns as they stand."""
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return out


def row_of(base):
    return [sum(k == kind for k, _, _ in base) for kind in KINDS] + [hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()]


def test_base_patterns_on_odd_strings():
    rnd = random.Random(3)
    for pieces in ("aB.@-1 é", "0123456789. +-()", "+1. ()-9", "12.34. .256", "a@b.c@d..e@-"):
        for _ in range(3000):
            text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40)))
            good = pii.base_spans(text)[: len(KINDS)]
            assert [(KINDS[k], s, e) for k in range(4) for s, e in good[k]] == plain_base(text), text


def test_long_runs_are_linear():
    for piece in ("x", "1", "1.", "+1", "a@", "1 ", "(", "dot ", "1:", "12 34 "):
        assert isinstance(pii.found(piece * 100_000), list)


def card(rnd, n=16, prefix="4"):
    body = prefix + "".join(rnd.choice("0123456789") for _ in range(n - 1 - len(prefix)))
    return next(body + d for d in "0123456789" if luhn(body + d))


def corpus(seed=2, n=400):
    """(doc_id, text, spans that a reader would add to the base ones)."""
    rnd, rows = random.Random(seed), []
    words = "the red house was sold to a man from there who lived near old mill".split()
    for i in range(n):
        pick = lambda: " ".join(rnd.choices(words, k=rnd.randint(2, 9)))
        octets = [str(rnd.randint(1, 223)) for _ in range(4)]
        what = i % 8
        number = f"{rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}"
        piece, added = {
            0: (f"mail jim{i}@example.com", None),
            1: ("host " + ".".join(octets), None),
            2: ("card " + card(rnd), None),
            3: ("phone +1 (" + number, None),
            4: (f"mail jim{i} (at) example (dot) com", "email"),
            5: ("phone +1 (" + number + " " + ".".join(octets), "phone"),
            6: ("version 1.2.3.999 token " + "".join(rnd.choice("0123456789abcdef") for _ in range(40)), None),
            7: ("server " + "[.]".join(octets), "ip"),
        }[what]
        rows.append((i, f"{pick()} {piece} {pick()}", added))
    return rows


def test_added_spans(spark):
    rows = corpus()
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, text, added in rows:
        base = plain_base(text)
        assert [got[i][f"n_{k}"] for k in KINDS] + [got[i].base_sha256] == row_of(base)
        spans = [x.split(":") for x in got[i].spans.split(",") if x]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(got[i].spans.split(",")) | {""}
        assert len(spans) == len(base) + got[i].n_added
        assert [(KINDS.index(k), int(s)) for k, s, _ in spans] == sorted((KINDS.index(k), int(s)) for k, s, _ in spans)
        if added:
            assert any(k == added and (k, int(s), int(e)) not in base for k, s, e in spans), text
        else:
            assert got[i].n_added == 0, text


def test_em_finds_reliable_labelers():
    """Labelers of known reliability: the estimates come near, and the bad labeler is found."""
    rnd = np.random.default_rng(1)
    truth = rnd.random(20_000) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.5])
    votes = np.where(rnd.random((len(truth), 6)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    chance, reliability = pii.expectation_maximisation(patterns, counts.astype(float))
    assert ((chance[at.ravel()] > 0.5) == truth).mean() > 0.97
    assert np.abs(reliability[:, 1, 2] - right).max() < 0.03


def test_em_against_a_plain_loop():
    rnd = np.random.default_rng(2)
    patterns, counts = rnd.integers(-1, 2, (40, 6)), rnd.integers(1, 50, 40)
    patterns = np.unique(patterns, axis=0)
    counts = counts[: len(patterns)].astype(float)
    got, _ = pii.expectation_maximisation(patterns, counts)
    chance = [1 / (1 + np.exp(-sum(p))) for p in patterns]
    for _ in range(pii.ROUNDS):
        table, share = {}, {}
        for y in (0, 1):
            w = [(c if y else 1 - c) * n for c, n in zip(chance, counts)]
            share[y] = (sum(w) + 1) / (sum(counts) + 2)
            for j in range(6):
                for v in (-1, 0, 1):
                    seen = {(1, 1): 8, (0, -1): 8, (1, -1): 2, (0, 1): 2}.get((y, v), 1)
                    table[y, j, v] = (seen + sum(a for a, p in zip(w, patterns) if p[j] == v)) / (11 + sum(w))
        like = [[share[y] * np.prod([table[y, j, p[j]] for j in range(6)]) for y in (0, 1)] for p in patterns]
        chance = [b / (a + b) for a, b in like]
    assert np.allclose(got, chance, atol=1e-9)


def test_edges(spark, edge_docs, no_docs):
    rows = edge_docs.collect()
    got = personal_data(edge_docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(((r[0], r[1], r[2], r[3], r[4], r[5]) for r in got), key=key) == sorted(((r.doc_id, *row_of(plain_base(r.text))) for r in rows), key=key)
    assert personal_data(no_docs).collect() == []
    twice = spark.createDataFrame([(1, "a@b.c", 1, "x"), (1, "a@b.c", 1, "x"), (None, "+123456789", 2, "y")], "doc_id long, text string, n_email int, found string")
    assert sorted((r.doc_id or 0, r.spans) for r in personal_data(twice).collect()) == [(0, "phone:0:10"), (1, "email:0:5"), (1, "email:0:5")]


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op13_personal_data"](spark, sf_dir).collect()
    assert {r.doc_id: [r[f"n_{k}"] for k in KINDS] + [r.base_sha256] for r in got} == {i: row_of(plain_base(t)) for i, t in docs.items()}
    assert len(got) == len(docs)


@pytest.mark.parametrize("text, spans", [("0 (at) 1", ""), ("00493012345678", "")])
def test_nothing_without_evidence(spark, text, spans):
    got = personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got[0].spans == spans
