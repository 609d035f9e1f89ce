"""Prefix tables of any size as disjoint ranges of addresses.

Nested prefixes of several tables are flattened, bucket by bucket of leading bits, into ranges
that each stand for one answer of every table. Packed as sorted arrays they take a few bytes a
range, so a table of millions of prefixes reaches every task at a known size, and an address is
looked up once, by binary search, however many lengths the prefixes have: flows are not shuffled
on an address, in batch or stream.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweir.functions.ip import words
from netweir.operators.joins import _keep_column, fits_broadcast

#: A packed table may have so many bytes; each Python worker holds it once.
PACKED_BYTES = 128 * 1024 * 1024
BUCKET_BITS = 16
MAPPED = bytes(10) + b"\xff\xff"
V4_BITS = 96
#: Columns of ranges: family 4 or 6, first address (16 bytes, an IPv4 one mapped), values.
NONE = -1


def _valid(prefixes: DataFrame, attributes: list[str]) -> DataFrame:
    """hi, lo, plen, value of the rows that are prefixes, bits after the length cleared."""
    hi, lo = words(F.col("prefix"))
    rows = prefixes.select(hi.alias("hi"), lo.alias("lo"), F.col("plen").cast("int").alias("plen"), F.struct(*attributes).alias("value"))
    rows = rows.where(F.col("hi").isNotNull() & F.col("plen").between(0, 128))
    return rows.withColumns({"hi": F.col("hi").bitwiseAND(_keep_column(F.col("plen"))), "lo": F.col("lo").bitwiseAND(_keep_column(F.col("plen") - 64))})


def _coded(rows: DataFrame, values: DataFrame) -> DataFrame:
    """hi, lo, plen, code: one row per prefix, with the greatest value of equal ones.

    Codes rise with the values, so the greatest code is the greatest value's: a number, which is
    added up by hash where text would be sorted. Values too large to send are not put on every row.
    """
    key = ["hi", "lo", "plen"]
    if fits_broadcast(values):
        return rows.join(F.broadcast(values), "value").groupBy(*key).agg(F.max("code").alias("code"))
    return rows.groupBy(*key).agg(F.max("value").alias("value")).join(values, "value").select(*key, "code")


def _by_family(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes as long as a bucket's bits or longer (family, bucket, hi, lo, plen, code), and the
    longest of the shorter ones for each bucket (family, bucket, code).

    An IPv6 prefix that covers the mapped addresses holds for IPv4 too. Of the short prefixes
    there are 65,536 rows a family at most, and they go no further than that.
    """
    mapped = (F.col("hi") == 0) & (F.shiftrightunsigned("lo", 32) == 0xFFFF) & (F.col("plen") >= V4_BITS)
    # Zero up to the length, or equal to the mapped prefix up to it.
    covers = (F.col("plen") < V4_BITS) & (F.col("hi") == 0) & (F.shiftrightunsigned("lo", 32) == F.lit(0xFFFF).bitwiseAND(F.shiftrightunsigned(_keep_column(F.col("plen") - 64), 32)))
    v4 = rows.where(mapped | covers).withColumns({"family": F.lit(4), "bits": F.greatest(F.col("plen") - V4_BITS, F.lit(0)), "lead": F.shiftright("lo", 16).bitwiseAND(0xFFFF).cast("int")})
    v4 = v4.withColumn("lead", F.when(F.col("plen") < V4_BITS, 0).otherwise(F.col("lead")))
    v6 = rows.where(~mapped).withColumns({"family": F.lit(6), "bits": F.col("plen"), "lead": F.shiftrightunsigned("hi", 48).cast("int")})
    both = v4.unionByName(v6)
    long = both.where(F.col("bits") >= BUCKET_BITS).select("family", F.col("lead").alias("bucket"), "hi", "lo", "plen", "code")
    spread = F.sequence(F.col("lead"), F.expr(f"lead + shiftleft(1, {BUCKET_BITS} - bits) - 1"))
    short = both.where(F.col("bits") < BUCKET_BITS).select("family", F.explode(spread).alias("bucket"), F.struct("plen", "code").alias("best"))
    return long, short.groupBy("family", "bucket").agg(F.max("best").alias("best")).select("family", "bucket", "best.code")


def _edge(bucket: Column) -> Column:
    """The first address of a bucket (16 bytes); NULL behind the last IPv6 one."""
    v4 = F.lpad(F.hex(F.lit(0xFFFF << 32) + F.shiftleft(bucket.cast("long"), 16)), 32, "0")
    v6 = F.when(bucket < 1 << BUCKET_BITS, F.concat(F.lpad(F.hex(bucket), 4, "0"), F.lit("0" * 28)))
    return F.unhex(F.when(F.col("family") == 4, v4).otherwise(v6))


def _whole_buckets(short: DataFrame, used: DataFrame, names: list[str]) -> DataFrame:
    """Ranges of the buckets that only short prefixes cover."""
    codes = F.array(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("code"))), F.lit(NONE)) for n in names])
    plain = short.join(used, ["family", "bucket"], "left_anti").groupBy("family", "bucket").agg(codes.alias("codes"))
    begin = plain.select("family", F.lit(False).alias("closes"), _edge(F.col("bucket")).alias("first"), "codes")
    end = plain.select("family", F.lit(True).alias("closes"), _edge(F.col("bucket") + 1).alias("first"), F.array(*[F.lit(NONE)] * len(names)).alias("codes"))
    return begin.unionByName(end.where(F.col("first").isNotNull()))


def _bounds(family: int, bucket: int) -> tuple[int, int]:
    """First address of a bucket and the one after its last, as 128-bit numbers."""
    base, width = (int.from_bytes(MAPPED + bytes(4), "big"), 32 - BUCKET_BITS) if family == 4 else (0, 128 - BUCKET_BITS)
    return base + (bucket << width), base + ((bucket + 1) << width)


def sweep(prefixes: list[tuple[int, int, int]], default: int, begin: int, end: int) -> list[tuple[int, int]]:
    """(first address, code) of the ranges that prefixes (first, end, code), sorted by first
    address and length and nested in each other, cut ``begin`` to ``end`` into."""
    out, open_ = [(begin, default)], [(end, default)]
    for first, last, code in [*prefixes, (end, end, default)]:
        while len(open_) > 1 and open_[-1][0] <= first:
            over = open_.pop()[0]
            if over < end:
                out.append((over, open_[-1][1]))
        if first < end:
            open_.append((last, code))
            out.append((first, code))
    kept: list[tuple[int, int]] = []
    for first, code in out:  # a later entry for the same address is the inner one
        if kept and kept[-1][0] == first:
            kept.pop()
        if not kept or kept[-1][1] != code:
            kept.append((first, code))
    return kept


def _bucket_ranges(family: int, bucket: int, pdf: pd.DataFrame, names: list[str]) -> list[tuple]:
    begin, end = _bounds(family, bucket)
    starts, per_table = {begin}, []
    for name in names:
        own = pdf[pdf["name"] == name]
        short, long = own[own["plen"] == NONE], own[own["plen"] != NONE]
        nested = []
        for hi, lo, plen, code in zip(long["hi"], long["lo"], long["plen"], long["code"]):
            first = (int(hi) % (1 << 64) << 64) + int(lo) % (1 << 64)
            nested.append((first, first + (1 << (128 - int(plen))), int(code)))
        ranges = sweep(sorted(nested, key=lambda p: (p[0], -p[1])), int(short["code"].iloc[0]) if len(short) else NONE, begin, end)
        per_table.append(ranges)
        starts |= {first for first, _ in ranges}
    rows, at = [], [0] * len(names)
    for first in sorted(starts):
        for t, ranges in enumerate(per_table):
            while at[t] + 1 < len(ranges) and ranges[at[t] + 1][0] <= first:
                at[t] += 1
        rows.append((family, False, first.to_bytes(16, "big"), [per_table[t][at[t]][1] for t in range(len(names))]))
    if end < 1 << 128:
        rows.append((family, True, end.to_bytes(16, "big"), [NONE] * len(names)))
    return rows


def _flattened(names: list[str]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [r for bucket, part in pdf.groupby("bucket") for r in _bucket_ranges(int(key[0]), int(bucket), part, names)]
        return pd.DataFrame(rows, columns=["family", "closes", "first", "codes"])

    return run


@dataclass(frozen=True)
class RangeTable:
    """ranges: family, closes, first, codes (one per table; places in ``values``, -1: none).

    A row that closes a bucket gives way to a row of the next one with the same first address.
    ``values``: per table its attributes by code. ``packed`` is None for a table beyond the limit.
    """

    ranges: DataFrame
    values: dict[str, DataFrame]
    attributes: dict[str, tuple[str, ...]]
    packed: object | None

    @staticmethod
    def of(tables: dict[str, tuple[DataFrame, list[str]]], store=lambda df, name: df, max_bytes: int = PACKED_BYTES) -> RangeTable:
        """Flatten tables of rows ``prefix`` (16 bytes), ``plen`` and attributes, by name.

        ``store`` writes a table and reads it back; codes are given once, when ``values`` is
        written. The tables are read twice, for values and for prefixes, and have to be stable.
        """
        names, values, longs, shorts = list(tables), {}, [], []
        spark = next(iter(tables.values()))[0].sparkSession
        for name, (prefixes, attributes) in tables.items():
            rows = _valid(prefixes, attributes)
            # As many rows as there are different answers: an order over them is small.
            distinct = rows.select("value").distinct()
            codes = distinct.withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))
            values[name] = store(codes.select("code", "value"), f"{name}-values")
            long, short = _by_family(store(_coded(rows, values[name]), f"{name}-prefixes"))
            longs.append(long.withColumn("name", F.lit(name)))
            shorts.append(short.withColumn("name", F.lit(name)))
        # The long prefixes are read off the stored ones; the short ones, a row a bucket, are kept.
        long, short = reduce(DataFrame.unionByName, longs), store(reduce(DataFrame.unionByName, shorts), "short")
        used = long.select("family", "bucket").distinct()
        # A short prefix has no length here; zeros, because pandas has no missing whole numbers.
        within = short.join(used, ["family", "bucket"], "left_semi").withColumns({"hi": F.lit(0).cast("long"), "lo": F.lit(0).cast("long"), "plen": F.lit(NONE)})
        inside = long.unionByName(within)
        # Buckets beside each other go together, so that there are few groups.
        groups = inside.withColumn("part", F.shiftright("bucket", 6)).groupBy("family", "part")
        ranges = groups.applyInPandas(_flattened(names), "family int, closes boolean, first binary, codes array<int>")
        ranges = store(ranges.unionByName(_whole_buckets(short, used, names)), "ranges")
        attributes = {n: tuple(a) for n, (_, a) in tables.items()}
        size = ranges.count() * (16 + 4 * len(names)) + sum(v.agg(F.sum(F.octet_length(F.to_json("value")))).first()[0] or 0 for v in values.values())
        packed = _packed(spark, ranges, values, names) if size <= max_bytes else None
        return RangeTable(ranges, values, attributes, packed)

    def lookup(self, facts: DataFrame, ip: str, out: str) -> DataFrame:
        """Add ``out``: a struct of one struct of attributes per table (NULL where none covers
        ``ip``)."""
        return self.lookup_ends(facts, {ip: out})

    def lookup_ends(self, facts: DataFrame, ends: dict[str, str]) -> DataFrame:
        """``lookup`` of several addresses of a row: ``ends`` names the output of each. A table
        beyond the limit resolves each distinct address once, whichever ends it is at, by a
        sorted merge with the ranges of its bucket; that needs a batch."""
        if self.packed is None:
            if facts.isStreaming:
                raise ValueError("a stream needs a range table within the packed size")
            return self._merge(facts, ends)
        return facts.withColumns({out: self._udf(facts.sparkSession)(F.col(ip)) for ip, out in ends.items()})

    def _type(self) -> str:
        return "struct<" + ",".join(f"{n}:{v.schema['value'].dataType.simpleString()}" for n, v in self.values.items()) + ">"

    def _udf(self, spark: SparkSession):
        sent = self.packed

        @F.arrow_udf(self._type())
        def find(addresses: pa.Array) -> pa.Array:
            return search(sent.value, addresses)

        return find

    def _merge(self, facts: DataFrame, ends: dict[str, str]) -> DataFrame:
        family = F.when(F.substring("first", 1, 12) == F.lit(MAPPED), 4).otherwise(6)
        lead = F.when(F.col("family") == 4, F.substring("first", 13, 2)).otherwise(F.substring("first", 1, 2))
        asked = reduce(DataFrame.unionAll, [facts.where(F.octet_length(ip) == 16).select(F.col(ip).alias("first")) for ip in ends])
        asked = asked.distinct().withColumn("family", family).select("family", "first", F.lit(1).alias("kind"), F.lit(None).cast("array<int>").alias("codes"))
        ranges = self.ranges.where("not closes").select("family", "first", F.lit(0).alias("kind"), "codes")
        both = asked.unionByName(ranges).withColumn("lead", lead)
        order = Window.partitionBy("family", "lead").orderBy("first", "kind").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("codes", F.last("codes", ignorenulls=True).over(order)).where("kind = 1")
        found = found.select("first", *[F.get("codes", F.lit(k)).alias(f"code_{k}") for k in range(len(self.values))])
        # Facts that move carry codes; small values join them where they are in the end.
        small = {name for name, table in self.values.items() if fits_broadcast(table)}
        late = []
        for k, (name, table) in enumerate(self.values.items()):
            if name not in small:
                found = found.join(table.select(F.col("code").alias(f"code_{k}"), F.col("value").alias(f"value_{k}")), f"code_{k}", "left").drop(f"code_{k}")
        for ip, out in ends.items():
            kept = [F.col(c).alias(f"{out}_{c}") for c in found.columns if c != "first"]
            facts = facts.join(found.select(F.col("first").alias(ip), *kept), ip, "left")
        for out in ends.values():
            for k, (name, table) in enumerate(self.values.items()):
                if name in small:
                    sent = F.broadcast(table.select(F.col("code").alias(f"{out}_code_{k}"), F.col("value").alias(f"{out}_value_{k}")))
                    facts = facts.join(sent, f"{out}_code_{k}", "left")
                    late.append(f"{out}_code_{k}")
                late.append(f"{out}_value_{k}")
        answers = {
            out: F.when(F.octet_length(ip) == 16, F.struct(*[F.col(f"{out}_value_{k}").alias(name) for k, name in enumerate(self.values)]))
            for ip, out in ends.items()
        }
        return facts.withColumns(answers).drop(*late)


@dataclass(frozen=True)
class Packed:
    """Sorted first addresses by family with a row of codes each, and the values by code."""

    v4: np.ndarray
    v4_codes: np.ndarray
    v6: np.ndarray
    v6_codes: np.ndarray
    values: dict[str, pa.Array]


def _packed(spark: SparkSession, ranges: DataFrame, values: dict[str, DataFrame], names: list[str]):
    """The packed table as a broadcast; its size was measured before."""
    parts = {}
    for family in (4, 6):
        got = ranges.where(F.col("family") == family).select("first", "closes", "codes").toArrow()
        keys = np.array([bytes(x) for x in got["first"].to_pylist()], "S16")
        closes = got["closes"].to_numpy(zero_copy_only=False).astype(bool)
        codes = np.array(got["codes"].to_pylist(), np.int32).reshape(len(keys), len(names))
        order = np.lexsort((~closes, keys))  # of equal addresses the last counts: not the one that closes
        keys, codes = keys[order], codes[order]
        last = np.append(keys[1:] != keys[:-1], True)[: len(keys)]
        parts[family] = keys[last], codes[last]
    number = _number(np.frombuffer(parts[4][0].tobytes(), np.uint8).reshape(-1, 16))
    known = {n: values[n].orderBy("code").select("value").toArrow()["value"].combine_chunks() for n in names}
    return spark.sparkContext.broadcast(Packed(number, parts[4][1], parts[6][0], parts[6][1], known))


def search(table: Packed, addresses: pa.Array) -> pa.Array:
    """The answers for a batch of addresses; one that has not 16 bytes has none."""
    if isinstance(addresses, pa.ChunkedArray):
        addresses = addresses.combine_chunks()
    raw = addresses.to_pylist()
    whole = np.array([x is not None and len(x) == 16 for x in raw], bool)
    data = np.frombuffer(b"".join(bytes(x) for x, ok in zip(raw, whole) if ok), np.uint8).reshape(-1, 16)
    codes = np.full((len(raw), len(table.values)), NONE, np.int32)
    mapped = (data[:, :12] == np.frombuffer(MAPPED, np.uint8)).all(axis=1)
    found = np.full((len(data), len(table.values)), NONE, np.int32)
    keys = np.frombuffer(data.tobytes(), "S16")
    for rows, wanted, firsts, answers in ((mapped, _number(data), table.v4, table.v4_codes), (~mapped, keys, table.v6, table.v6_codes)):
        at = np.searchsorted(firsts, wanted[rows], "right") - 1
        hit = at >= 0
        part = np.full((len(at), len(table.values)), NONE, np.int32)
        part[hit] = answers[at[hit]]
        found[rows] = part
    codes[whole] = found
    columns = [v.take(pa.array(codes[:, k], mask=codes[:, k] == NONE)) for k, v in enumerate(table.values.values())]
    return pa.StructArray.from_arrays(columns, names=list(table.values))


def _number(addresses: np.ndarray) -> np.ndarray:
    """The last seven bytes of addresses as numbers, which order mapped IPv4 ones and their end."""
    out = np.zeros(len(addresses), np.int64)
    for k in range(9, 16):
        out = out << 8 | addresses[:, k]
    return out
