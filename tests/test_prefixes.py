"""Longest-prefix match against brute force, all kinds of prefixes, both strategies."""

import random

import pytest
from pyspark.sql import functions as F

from netweir.operators.joins import PrefixTable, longest_prefix, lookup_left

V4 = 0xFFFF << 32


def cut(number, plen):
    return number >> (128 - plen) << (128 - plen)


def tables():
    rnd = random.Random(11)
    v4 = {(cut(V4 | rnd.getrandbits(32), 96 + n), 96 + n) for n in (8, 8, 12, 16, 20, 24, 24, 31, 32) for _ in range(20)}
    v6 = {(cut((0x20010DB8 << 96) | rnd.getrandbits(96), n), n) for n in (32, 40, 48, 57) for _ in range(10)}
    long6 = {(cut((0x20010DB8 << 96) | rnd.getrandbits(96), n), n) for n in (58, 64, 100, 128) for _ in range(10)}
    low = {(0, 0), (0, 80), (1 << 70, 60)}
    return {"v4": v4, "v4+v6": v4 | v6, "long v6": v4 | v6 | long6, "everything": v4 | v6 | long6 | low}


@pytest.mark.parametrize("strategy", ["probe", "distinct"])
@pytest.mark.parametrize("name", list(tables()))
def test_longest_prefix(spark, name, strategy):
    prefixes = sorted(tables()[name])
    rnd = random.Random(5)
    addresses = [p | rnd.getrandbits(128 - n) if n < 128 else p for p, n in prefixes for _ in range(3)]
    addresses += [V4 | rnd.getrandbits(32) for _ in range(100)] + [rnd.getrandbits(128) for _ in range(50)]
    addresses += [addresses[0]] * 200
    rows = [(p.to_bytes(16, "big"), n, f"{p:x}/{n}") for p, n in prefixes]
    table = PrefixTable.of(spark.createDataFrame(rows, "prefix binary, plen int, name string"), ["name"])
    facts = spark.createDataFrame(
        [(i, a.to_bytes(16, "big")) for i, a in enumerate(addresses)] + [(-1, b"")], "i int, ip binary"
    )
    found = longest_prefix(facts, "ip", table, {"name": "name"}, strategy).select("i", "name").collect()
    assert len(found) == len(addresses) + 1
    got = {r.i: r.name for r in found}
    assert got[-1] is None
    for i, a in enumerate(addresses):
        covering = [(n, p) for p, n in prefixes if cut(a, n) == p]
        want = f"{max(covering)[1]:x}/{max(covering)[0]}" if covering else None
        assert got[i] == want


def test_empty_table(spark):
    table = PrefixTable.of(spark.createDataFrame([], "prefix binary, plen int, name string"), ["name"])
    facts = spark.createDataFrame([(1, bytes(16))], "i int, ip binary")
    assert longest_prefix(facts, "ip", table, {"name": "name"}).collect()[0]["name"] is None


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_lookup_same_result_broadcast_or_salted(spark, limit):
    facts = spark.range(1000).select("id", F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 50).alias("k"))
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = lookup_left(facts, dim, ["k"], max_bytes=limit)
    assert ("_salt" in joined._jdf.queryExecution().optimizedPlan().toString()) == (limit == 0)
    rows = joined.collect()
    assert len(rows) == 1000
    assert all(r.v == (r.k * 2 if r.k < 40 else None) for r in rows)


@pytest.mark.parametrize("strategy", ["probe", "distinct"])
@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_doubled_and_unmasked_prefixes_keep_one_row_per_flow(spark, strategy, limit):
    ten = V4 | 10 << 24
    rows = [(ten | 5, 104, "A"), (ten, 104, "B"), (ten | 1 << 16, 112, "C"), (ten, 200, "no"), (None, 8, "no")]
    rows += [(V4 | n << 24 | 99, 96 + n % 33, f"{n}") for n in range(40, 90)]
    rows += [((0x20010DB8 << 96) | 7, n, f"v6/{n}") for n in range(1, 129)]
    frame = [(p.to_bytes(16, "big") if p is not None else None, n, a) for p, n, a in rows]
    table = PrefixTable.of(spark.createDataFrame(frame, "prefix binary, plen int, name string"), ["name"], max_bytes=limit)
    assert len(table.probes()) <= 25
    addresses = [ten | 77, ten | 1 << 16 | 3, (0x20010DB8 << 96) | 7, (0x20010DB8 << 96) | 6, V4 | 11 << 24] * 3
    facts = spark.createDataFrame([(i, a.to_bytes(16, "big"), {"k": "v"}) for i, a in enumerate(addresses)], "i int, ip binary, tags map<string,string>")
    found = {r.i: r.name for r in longest_prefix(facts, "ip", table, {"name": "name"}, strategy).collect()}
    assert len(found) == len(addresses)
    assert [found[i] for i in range(5)] == ["B", "C", "v6/128", "v6/127", "67"]


def test_a_stream_meets_a_large_table(spark, tmp_path):
    """The table does not fit a broadcast; the stream still gets every flow once."""
    rows = [((V4 | 10 << 24 | n << 8).to_bytes(16, "big"), plen, f"{n}/{plen}") for n in range(50) for plen in range(97, 129)]
    table = PrefixTable.of(spark.createDataFrame(rows, "prefix binary, plen int, name string"), ["name"], max_bytes=0)
    facts = spark.createDataFrame([(i, (V4 | 10 << 24 | i % 60 << 8).to_bytes(16, "big")) for i in range(200)], "i int, ip binary")
    facts.write.parquet(str(tmp_path / "in"))
    stream = longest_prefix(spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in")), "ip", table, {"name": "name"})
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {r.i: r.name for r in longest_prefix(facts, "ip", table, {"name": "name"}).collect()}
    assert {r.i: r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want and len(want) == 200
