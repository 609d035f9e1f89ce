import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweir.llm import quality_trees as qt
from netweir.llm import toxic_segments as ts
from netweir.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_flat_trees_walk_like_rules():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, len(qt.STATS)))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    model = qt.fit_forest(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    # One row at a time, by following the nodes.
    for row in x[2000:2020]:
        total = model.start
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.limit[at] else model.right[at]
            total += model.value[at]
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_one_class_or_no_labels():
    x = np.zeros((5, len(qt.STATS)))
    assert 0.5 < qt.fit_forest(x, np.ones(5)).score(x)[0] < 1
    assert qt.fit_forest(x[:0], np.ones(0)).score(x)[0] == 0.5


def test_statistics_of_edges():
    for t in (None, "", " \n"):
        assert not qt.statistics(t).any()
    s = dict(zip(qt.STATS, qt.statistics("AB ab!! AB\nAB ab!! AB\n1 #")))
    assert np.exp(s["words"]) - 1 == pytest.approx(8) and s["repeated_lines"] == pytest.approx(1 / 3) and s["digit_words"] == 1 / 8 and s["marked_words"] == 3 / 8
    assert np.isfinite(qt.statistics("x " * 100_000)).all()


def brute_segments(scores):
    """Maximal segments by their definition: split around the best, again and again."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[2] or (s == best[2] and b - a < best[1] - best[0])):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return brute_segments(scores[:a]) + [best] + [(x + b, y + b, z) for x, y, z in brute_segments(scores[b:])]


def test_maximal_segments():
    rnd = random.Random(3)
    for _ in range(200):
        scores = [rnd.uniform(-3, 2) for _ in range(rnd.randint(0, 14))]
        got = [(a, b, round(s, 9)) for a, b, s in ts.maximal_segments(scores)]
        assert got == [(a, b, round(s, 9)) for a, b, s in brute_segments(scores)]


@pytest.mark.parametrize("query,label,least", [("op8_quality_trees", "quality", 0.97), ("op10_toxic_segments", "toxic", 0.9)])
def test_held_out(spark, query, label, least):
    scored = QUERIES[query](spark, SF)
    got = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter(F.col("held_out")).toPandas()
    assert scored.count() == 1000
    assert ((got["predicted"] == got[label]).mean()) >= least
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all()


def test_toxic_edges(spark, edge_docs, no_docs):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(50)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(30)) + (" vile brute" * 3 if k % 3 == 0 else "")) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)] + [(None, 1), (5, None), (999, 1)], "doc_id long, label int")
    model = ts.fit_toxicity(docs, labels)
    got = {r.doc_id: r.p for r in ts.score_toxicity(docs, model, "p").collect()}
    assert all((p >= 0.7) == (k % 3 == 0) for k, p in got.items())
    passages = ts.toxic_passages(docs.filter("doc_id < 2"), model).collect()
    assert [(r.doc_id, r.words) for r in passages] == [(0, "vile brute")] and passages[0].first_word == 30
    scored = ts.score_toxicity(edge_docs, model, "p")
    assert scored.columns == [*edge_docs.columns, "p"] and scored.count() == edge_docs.count() and scored.filter("p >= 0.7").count() == 0
    assert ts.score_toxicity(no_docs, model, "p").collect() == []
    nothing = ts.fit_toxicity(no_docs, labels)
    assert ts.score_toxicity(docs, nothing, "p").filter("p >= 0.7").count() == 0


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (8, 0), (9, 0), (None, 1), (11, 1)], "doc_id long, label int")
    model = qt.fit_quality(edge_docs.select("doc_id", "text"), labels)
    scored = qt.score_quality(edge_docs, model, "p")
    assert scored.columns == [*edge_docs.columns, "p"] and scored.count() == edge_docs.count()
    assert scored.filter("p is null or p < 0 or p > 1").count() == 0
    assert qt.score_quality(no_docs, model, "p").collect() == []
    assert qt.fit_quality(no_docs, labels).score(np.zeros((1, len(qt.STATS))))[0] == 0.5
