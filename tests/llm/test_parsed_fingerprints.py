import hashlib
import random

import numpy as np
from edge_rows import EDGE

from netweir.llm import parsed_fingerprints as pf


def text(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def alike(a, b):
    x = pf.fingerprints([a, b])
    return float(pf.likeness(x[:1], x[1:])[0])


def test_equal_substrings_share_names_at_any_offset():
    a = text(1, 400)
    moved = text(2, 5) + a
    names = [set(n.tolist()) for level in pf.phrase_names([a])[:3] for n in level[:1]]
    other = [set(n.tolist()) for level in pf.phrase_names([moved])[:3] for n in level[:1]]
    for x, y in zip(names, other):
        assert len(x - y) <= 6
    assert alike(a, moved) > 0.9
    assert alike(a, text(3, 400)) < 0.1
    assert alike(a, a) == 1.0 and alike("", "") == 1.0 and alike("", a) == 0.0


def test_batches_do_not_matter():
    texts = [text(k, k) for k in range(30)] + ["", "a", "aaaa" * 50, "é😀"]
    together = pf.fingerprints(texts)
    for t, row in zip(texts, together):
        assert (pf.fingerprints([t])[0] == row).all()


def test_edited_and_next(spark, edge_docs):
    rows = [(i, text(i, 3 + 7 * (i % 11))) for i in range(90)] + [(i + 100, t) for i, t in EDGE if i not in (None, 11)]
    got = {r.doc_id: r for r in pf.edited_and_next(spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, part string")).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        prints = pf.fingerprints([t, new, following])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (pf.as_text(prints[0]), pf.as_text(prints[1]))
        assert np.isclose(r.near_edited, pf.likeness(prints[0], prints[1])) and np.isclose(r.near_next, pf.likeness(prints[0], prints[2]))
    assert pf.edited_and_next(edge_docs).count() == len(EDGE)


def test_one_and_none(spark, no_docs):
    (r,) = pf.edited_and_next(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.n_chars == 6
    assert pf.edited_and_next(no_docs).collect() == []
    assert pf.fingerprint_texts(no_docs).collect() == []
