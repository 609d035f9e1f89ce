import math
from itertools import combinations

import numpy as np
import pytest

import netweir.llm.epsilon_grid as eg


def brute(rows, limit):
    root = {i: i for i, _ in rows}
    links = {i: 0 for i, _ in rows}
    unit = {}
    for i, v in rows:
        if v and None not in v and all(map(math.isfinite, v)) and any(v):
            unit[i] = np.array(v) / np.linalg.norm(v)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(unit), 2):
        if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= limit:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i in root}


@pytest.mark.parametrize("interval", [4096, 16])
def test_same_as_all_pairs(spark, monkeypatch, interval):
    monkeypatch.setattr(eg, "INTERVAL", interval)
    monkeypatch.setattr(eg, "BLOCK", 8)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 10))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=10) * (0.02 if i % 3 else 0.2)]) for i in range(150)]
    rows += [(200, rows[0][1]), (201, [x * 2 for x in rows[0][1]]), (202, None), (203, []), (204, [0.0] * 10), (205, [float("nan")] + [1.0] * 9), (206, [None] + [1.0] * 9), (207, [float("inf")] * 10), (208, [1.0, 2.0]), (209, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, weight int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in eg.near_vectors(df, 0.95).collect()}
    assert got == brute(rows, 0.95)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_same_as_all_pairs_in_more_dimensions_than_axes(spark, monkeypatch, kind):
    """Cosines around the limit, over many intervals and blocks."""
    monkeypatch.setattr(eg, "INTERVAL", 32)
    monkeypatch.setattr(eg, "BLOCK", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(120, 48))
    v = np.concatenate([centres, centres + rng.normal(size=centres.shape) * 0.33, centres[:60] + rng.normal(size=(60, 48)) * 0.2]).astype(np.float32)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in eg.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), 0.95).collect()}
    want = brute(rows, 0.95)
    assert got == want and 50 < sum(n > 0 for n, _, _ in want.values()) < 290


def test_nothing_is_shuffled_per_pair_of_intervals(spark, monkeypatch):
    """The comparison reads its intervals where they are stored."""
    monkeypatch.setattr(eg, "INTERVAL", 16)
    plans, stored = {}, eg.stored

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(eg, "stored", noted)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(200)]
    eg.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert "Exchange" not in plans["found"] and "CartesianProduct" in plans["found"]


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in eg.near_vectors(df).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_empty(spark):
    assert eg.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
