"""Range tables against the plain rule: the longest prefix that covers an address."""

from dataclasses import replace
import random

import pytest
from pyspark.sql import functions as F

from netweir.operators import ranges
from netweir.plans import flow_queries as fq
from netweir.plans import stream_queries as sq
from netweir.operators.ranges import MAPPED, RangeTable, sweep

SCHEMA = "prefix binary, plen int, country string, city string"


def masked(address, plen):
    number = int.from_bytes(address, "big") >> (128 - plen) << (128 - plen) if plen else 0
    return number.to_bytes(16, "big")


def prefixes(seed, n, crowded=False):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        if rnd.random() < 0.6:
            address = MAPPED + bytes([rnd.choice([10, 10, 172, 255, 0]), rnd.randint(0, 3), rnd.randint(0, 255), rnd.randint(0, 255)])
            plen = 96 + rnd.choice([0, 1, 4, 8, 12, 15, 16, 17, 20, 24, 29, 31, 32])
        else:
            address = bytes([0x20, 0x01] if rnd.random() < 0.6 else [rnd.randint(0, 255), 0]) + bytes(rnd.randint(0, 1) * rnd.randint(0, 255) for _ in range(14))
            plen = rnd.choice([0, 1, 3, 12, 16, 17, 32, 33, 48, 64, 65, 95, 96, 127, 128] if i % 9 else [0, 80, 90, 95])
        rows.append((masked(address, plen), plen, f"c{rnd.randint(0, 9)}", f"p{i}"))
    rows += [(bytes(16), 80, "v", "zero"), (masked(MAPPED + bytes(4), 90), 90, "v", "near"), (b"short", 8, "x", "x"), (None, 8, "x", "x"), (bytes(16), 129, "x", "x")]
    return rows + rows[:5]


def plain(rows, address):
    if address is None or len(address) != 16:
        return None
    best = None
    for prefix, plen, *value in rows:
        if prefix is not None and len(prefix) == 16 and plen <= 128 and masked(address, plen) == prefix:
            best = max(best, (plen, tuple(value))) if best else (plen, tuple(value))
    return best[1] if best else None


def addresses(rows, seed):
    rnd, out = random.Random(seed), [None, b"", b"\x01\x02\x03\x04", bytes(16), b"\xff" * 16, MAPPED + bytes(4), MAPPED + b"\xff" * 4]
    for prefix, plen, *_ in rows:
        if prefix is None or len(prefix) != 16 or plen > 128:
            continue
        number, size = int.from_bytes(prefix, "big"), 1 << (128 - plen)
        for x in (number, number + size - 1, number + size, number - 1, number + rnd.randrange(size)):
            out.append((x % (1 << 128)).to_bytes(16, "big"))
    return out


@pytest.mark.parametrize("max_bytes", [1 << 30, 0])
def test_longest_prefix_of_several_tables(spark, max_bytes):
    geo, sites = prefixes(1, 120), [r[:3] for r in prefixes(2, 30)]
    table = RangeTable.of(
        {"geo": (spark.createDataFrame(geo, SCHEMA), ["country", "city"]), "site": (spark.createDataFrame(sites, "prefix binary, plen int, name string"), ["name"])}, max_bytes=max_bytes
    )
    assert (table.packed is None) == (max_bytes == 0)
    asked = addresses(geo + [(*s, "") for s in sites], 3)
    facts = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "id int, ip binary").repartition(3)
    got = {r.id: r.hit for r in table.lookup(facts, "ip", "hit").collect()}
    assert len(got) == len(asked)
    for i, a in enumerate(asked):
        hit = got[i]
        assert (tuple(hit.geo) if hit and hit.geo else None, tuple(hit.site) if hit and hit.site else None) == (plain(geo, a), plain(sites, a)), a


def test_flows_move_with_codes(spark, sf_dir, monkeypatch):
    """The text of the answers joins flows after their last move, not before it."""
    whole, want = fq.wide_table, fq.enrich_wide_table(spark, sf_dir).collect()
    monkeypatch.setattr(fq, "wide_table", lambda s, d: replace(whole(s, d), packed=None))
    merged = fq.enrich_wide_table(spark, sf_dir)
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, want)) and len(want) > 100
    joins = [line for line in merged._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert ["broadcast" in line for line in joins] == [True, True, False, False]


@pytest.mark.parametrize("large", [False, True])
def test_several_ends_at_once(spark, monkeypatch, large):
    """Merged, with values that may be sent and with values that may not, as packed."""
    if large:
        monkeypatch.setattr(ranges, "fits_broadcast", lambda df: False)
    geo, sites = prefixes(4, 60), [r[:3] for r in prefixes(5, 20)]
    given = {"geo": (spark.createDataFrame(geo, SCHEMA), ["country", "city"]), "site": (spark.createDataFrame(sites, "prefix binary, plen int, name string"), ["name"])}
    asked = addresses(geo, 6)
    facts = spark.createDataFrame([(i, a, asked[-i]) for i, a in enumerate(asked)], "id int, a binary, b binary")
    found = []
    for max_bytes in (1 << 30, 0):
        out = RangeTable.of(given, max_bytes=max_bytes).lookup_ends(facts, {"a": "x", "b": "y"})
        assert sorted(out.columns) == ["a", "b", "id", "x", "y"]
        found.append(sorted(tuple(r) for r in out.select("id", *[f"{e}.{f}" for e in "xy" for f in ("geo.country", "geo.city", "site.name")]).collect()))
    assert found[0] == found[1] and len(found[0]) == len(asked)


def test_text_of_equal_prefixes_is_not_sorted(spark):
    """Equal prefixes are reduced by a number, in a hash table."""
    seen = []

    def store(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return df

    rows = prefixes(1, 40) + [(bytes(16), 80, None, "zero"), (bytes(16), 80, "v", "zero2")]
    table = RangeTable.of({"geo": (spark.createDataFrame(rows, SCHEMA), ["country", "city"])}, store)
    assert "SortAggregate" not in dict(seen)["geo-prefixes"]
    hit = table.lookup(spark.createDataFrame([(bytes(16),)], "ip binary"), "ip", "hit").first().hit
    assert tuple(hit.geo) == max(r[2:] for r in rows if r[0] == bytes(16) and r[1] == 80 and r[2])


def test_sweep():
    assert sweep([], -1, 0, 16) == [(0, -1)]
    assert sweep([(0, 16, 1)], -1, 0, 16) == [(0, 1)]
    assert sweep([(0, 8, 1), (0, 4, 2), (4, 6, 3), (12, 16, 1)], 0, 0, 16) == [(0, 2), (4, 3), (6, 1), (8, 0), (12, 1)]
    assert sweep([(4, 8, 1), (6, 8, 1), (8, 9, 2)], 0, 0, 16) == [(0, 0), (4, 1), (8, 2), (9, 0)]


def test_flows_are_not_shuffled(spark, tmp_path):
    table = RangeTable.of({"geo": (spark.createDataFrame(prefixes(1, 40), SCHEMA), ["country", "city"])})
    spark.range(100).select(F.unhex(F.lit("00000000000000000000FFFF0A000001")).alias("ip")).write.parquet(str(tmp_path / "f"))
    for flows in (spark.read.parquet(str(tmp_path / "f")), spark.readStream.schema("ip binary").parquet(str(tmp_path / "f"))):
        found = table.lookup(flows, "ip", "hit")
        plan = found._jdf.queryExecution().analyzed().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "Repartition" not in plan


def test_empty_table(spark):
    table = RangeTable.of({"geo": (spark.createDataFrame([], SCHEMA), ["country", "city"])})
    facts = spark.createDataFrame([(1, MAPPED + bytes(4)), (2, None)], "id int, ip binary")
    assert [r.hit.geo for r in table.lookup(facts, "ip", "hit").collect()] == [None, None]


def test_a_stream_looks_up_a_table_beyond_the_packed_size(spark, sf_dir, monkeypatch):
    """Each batch of the stream is merged with the ranges; the rows are those of the batch query."""
    whole = fq.wide_table
    want = fq.enrich_wide_table(spark, sf_dir).collect()
    monkeypatch.setattr(fq, "wide_table", lambda s, d: replace(whole(s, d), packed=None))
    got = sq.stream_enrich_wide_table(spark, sf_dir).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 100
