"""Chunked neighbour operators against brute force, with chunks far smaller than the data."""

import random

import pytest

from netweir.operators.ordered import carry, overlapping_chunks, runs, with_neighbors


def data(seed, n=300, hot=0.4):
    rnd = random.Random(seed)
    rows = set()
    while len(rows) < n:
        key = "hot" if rnd.random() < hot else rnd.choice("abcde")
        rows.add((key, rnd.randrange(-500, 1500)))
    return sorted(rows)


def by_key(rows):
    out = {}
    for key, x in rows:
        out.setdefault(key, []).append(x)
    return out


@pytest.mark.parametrize("chunk", [1, 7, 100, 10_000])
def test_neighbors(spark, chunk):
    rows = data(chunk)
    df = spark.createDataFrame(rows, "key string, x bigint").repartition(5)
    got = with_neighbors(df, ["key"], "x", chunk, before={"x": "p"}, after={"x": "n"}).collect()
    want = set()
    for key, xs in by_key(rows).items():
        for i, x in enumerate(xs):
            want.add((key, x, xs[i - 1] if i else None, xs[i + 1] if i + 1 < len(xs) else None))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("back", [False, True])
@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_carry(spark, chunk, back):
    rnd = random.Random(chunk)
    rows = [(k, x, rnd.randrange(9) if rnd.random() < 0.1 else None) for k, x in data(chunk)]
    df = spark.createDataFrame(rows, "key string, x bigint, v int").repartition(5)
    got = {(r.key, r.x): r.out for r in carry(df, ["key"], "x", "v", "out", chunk, back).collect()}
    want, seen = {}, {}
    for k, x, val in sorted(rows, key=lambda r: r[1], reverse=back):
        if val is not None:
            seen[k] = val
        want[(k, x)] = seen.get(k)
    assert got == want


@pytest.mark.parametrize("chunk", [1, 5, 10_000])
def test_runs(spark, chunk):
    rnd = random.Random(3)
    rows = [(k, x) for k in ("hot", "a", "b") for x in range(-60, 120) if rnd.random() < 0.8]
    df = spark.createDataFrame(rows, "key string, x bigint").repartition(5)
    got = {tuple(r) for r in runs(df, ["key"], "x", chunk).collect()}
    want = set()
    for key, xs in by_key(rows).items():
        first = last = xs[0]
        for x in xs[1:] + [None]:
            if x is not None and x == last + 1:
                last = x
                continue
            want.add((key, first, last))
            first = last = x
    assert got == want


def test_chunks_must_cover_the_reach(spark):
    with pytest.raises(ValueError):
        overlapping_chunks(spark.range(1), "id", 10, 5)
