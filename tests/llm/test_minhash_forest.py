import random
import re
from itertools import combinations

import numpy as np
import pytest

from netweir.llm import minhash_forest
from netweir.llm.common import shingles
from netweir.llm.minhash_forest import near_duplicates
from netweir.llm.queries import QUERIES


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, n):
    """{doc_id: (size, component)} by comparing all pairs."""
    sets = {i: shingle_set(t, n) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=4, groups=8):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for g in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.choice([1, 2, 5, 40 if g == 3 else 8])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    return rows


@pytest.mark.parametrize("words", [4, 5])
def test_same_as_all_pairs(spark, words):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows, words).items()}


def test_edges(edge_docs):
    got = near_duplicates(edge_docs, 4).collect()
    want = brute([(r.doc_id, r.text) for r in edge_docs.collect()], 4)
    assert len(got) == edge_docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_empty(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_minhash_forest"](spark, sf_dir).collect()}
    assert got == brute(rows, 4)


def by_row(rows, n):
    """(doc_id, size, component, kept) of every row, texts under one doc_id kept apart."""
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        x, y = sets[i], sets[j]
        if x and y and rows[i][0] is not None and rows[j][0] is not None and 100 * len(x & y) >= 80 * len(x | y):
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((i, len(x), least.get(find(k)), i is None or least[find(k)] == i) for k, ((i, _), x) in enumerate(zip(rows, sets))), key=str)


def test_texts_that_share_a_doc_id(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 25), t) for _, t in corpus(6, 6)] + [(1, "p q r s t u"), (1, "k l m n o"), (2, "k l m n o"), (None, "k l m n o"), (3, None), (3, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_row(rows, 4)


def test_crowded_runs(spark, monkeypatch):
    """Many near copies of one text, some too far from most of the others, in small blocks."""
    monkeypatch.setattr(minhash_forest, "BLOCK", 8)  # read on the driver
    rnd = random.Random(12)
    base, rows = [f"b{k}" for k in range(150)], []
    for i in range(220):
        copy = list(base)
        for k in range(rnd.choice([0, 1, 2, 3, 5, 7, 8])):
            copy[rnd.randrange(len(copy))] = f"e{i}" if rnd.random() < 0.7 else f"x{k}"
        rows.append((i, " ".join(copy)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len({r.component_id for r in got}) > 1
    assert sorted((tuple(r) for r in got), key=str) == by_row(rows, 4)


def test_overlaps_by_matrix_products(monkeypatch):
    monkeypatch.setattr(minhash_forest, "COLUMNS", 16)
    texts = [t for _, t in corpus(3, 6)][:60] + ["one", "one", ""]
    sets = [shingles(t, 4) for t in texts]
    want = [[bool(len(x) + len(y)) and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)) for y in sets] for x in sets]
    got = minhash_forest.linked(sets, 80)
    at = [i for i, x in enumerate(sets) if len(x)]
    assert (got[np.ix_(at, at)] == np.array(want)[np.ix_(at, at)]).all()


def test_forest_joins_what_links_join():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 9, 40):
        link = rnd.random((n, n)) < 1.2 / n
        link |= link.T
        known = rnd.integers(0, max(1, n // 2), n)
        pairs = minhash_forest.forest(link, known)
        label = list(range(n))

        def joined(pairs):
            label = list(range(n))
            for _ in range(n):
                for i, j in pairs:
                    label[i] = label[j] = min(label[i], label[j])
            return label

        same = [(i, j) for i in range(n) for j in range(n) if known[i] == known[j]]
        assert joined(same + pairs) == joined(same + [(int(i), int(j)) for i, j in np.argwhere(link)])
        assert len(pairs) < len(set(known.tolist())) or not pairs
