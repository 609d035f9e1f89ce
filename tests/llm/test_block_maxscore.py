import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from netweir.llm import block_maxscore
from netweir.llm.block_maxscore import build_index, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for item, wanted in asked.items():
        found = []
        for i, bag, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in wanted if bag[t])
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out |= {(item, rank + 1, i, score) for rank, (score, i) in enumerate(found[:k])}
    return out


def corpus(n, seed=5):
    """Words of very uneven frequency, copies, and texts of very uneven length."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(i, " ".join(rnd.choices(words, weights, k=int(rnd.lognormvariate(3, 1)) + 1))) for i in range(n)]
    rnd.shuffle(docs)
    return docs + [(n + i, docs[0][1].upper()) for i in range(60)]


def test_same_as_scoring_everything(spark):
    docs = corpus(3000)
    items = [(i, " ".join(f"w{k}" for k in range(i, 300, 7 + i))) for i in range(12)] + [(99, docs[0][1])]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = {tuple(r) for r in search(index, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items)


@pytest.mark.parametrize("window", [1, 64, 100_000])
def test_windows_of_any_size(monkeypatch, window):
    import pyarrow as pa

    from netweir.llm.terms import term_bytes

    monkeypatch.setattr(block_maxscore, "FIRST_WINDOW", window)
    docs = corpus(1500, 11)
    items = [(i, " ".join(f"w{k}" for k in range(i, 300, 11 + i))) for i in range(6)]
    shard = block_maxscore.Shard(0)
    shard.add(pa.array([i for i, _ in docs]), pa.array([t for _, t in docs]), term_bytes(True))
    rows = shard.rows().to_pylist()
    n, scale = np.frombuffer(rows[0]["last"], "<i8"), (rows[0]["df"], rows[0]["total"])
    found = set()
    for item, text in items:
        lists = []
        for row in rows[1:]:
            if row["term"].decode() in terms(text):
                weight = math.floor(1000 * math.log((2 * scale[0] + 2) / (2 * row["df"] + 1)))
                lists.append(block_maxscore.Postings(type("Row", (), row), weight, scale, block_maxscore.lengthened(n, *scale)))
        ids, score = block_maxscore.best_of_shard(lists, np.array([i for i, _ in docs]), 50)
        order = np.lexsort((ids, -score))
        found |= {(item, k + 1, int(ids[o]), int(score[o])) for k, o in enumerate(order)}
    assert found == brute(docs, items)


def test_many_shards_and_query_blocks(spark, monkeypatch):
    docs, items = corpus(500, 9), [(i, f"w{i % 40} w{i % 7} w{100 + i}") for i in range(60)]
    monkeypatch.setattr(block_maxscore, "QUERIES", 7)
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(40))
    got = {tuple(r) for r in search(index, spark.createDataFrame(items, "item_id long, text string"), 5).collect()}
    assert got == brute(docs, items, 5)


def test_shards_of_bounded_size():
    import pyarrow as pa

    from netweir.llm.terms import term_bytes

    shard = block_maxscore.Shard(0)
    shard.add(pa.array([3, None, 4]), pa.array(["b a a", "", "a " * 70_000]), term_bytes(True))
    rows = shard.rows().to_pylist()
    assert [r["term"] for r in rows] == [None, b"a", b"b"] or [r["term"] for r in rows] == [None, b"b", b"a"]
    a = next(r for r in rows if r["term"] == b"a")
    p = block_maxscore.Postings(type("Row", (), a), 1, (2, 70_003), np.array([100, 100, 100]))
    doc, add = p.block(0)
    assert doc.tolist() == [0, 2] and add.tolist() == [2 * 10**9 // 4000, 70_000 * 10**9 // (1000 * 70_000 + 2000)]


def test_blocks_are_rejected_unread():
    """A list that can't lift any document above the threshold stays compressed."""
    import pyarrow as pa

    from netweir.llm.terms import term_bytes

    shard = block_maxscore.Shard(0)
    n = 5000
    shard.add(pa.array(range(n)), pa.array([("rare " if i < 60 else "") + "common" for i in range(n)]), term_bytes(True))
    docs, total, m = n, n + 60, block_maxscore.lengthened(np.where(np.arange(n) < 60, 2, 1), n, n + 60)
    rare, common = (block_maxscore.Postings(type("Row", (), r), w, (docs, total), m) for r in shard.rows().to_pylist()[1:] for w in [5000 if r["term"] == b"rare" else 1])
    ids, score = block_maxscore.best_of_shard([common, rare], np.arange(n), 50)
    assert sorted(ids.tolist()) == list(range(50)) and len(common.known) < len(common.last)


def test_edges(spark, edge_docs, no_docs):
    items = [(1, "one two"), (1, "three"), (2, ""), (3, None), (None, "WORD hi"), (4, "nowhere"), (5, "é 中文 a-b")]
    queries = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, doc_id int, term string")
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = sorted((tuple(r) for r in search(build_index(edge_docs), queries).collect()), key=str)
    # Rows that repeat a null or an id may change places among equal scores, but look the same.
    assert got == sorted(brute(docs, items), key=str)
    assert search(build_index(no_docs), queries).collect() == []
    assert search(build_index(edge_docs), queries.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None), (2, " - ")], "doc_id long, text string")
    assert search(build_index(blank), queries).collect() == []
