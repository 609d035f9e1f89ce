"""Lookup joins: size-checked broadcast, salted shuffle, longest-prefix match."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweir.functions.ip import words

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16


def _width(df: DataFrame) -> Column:
    """Approximate bytes of a row: its text and binary lengths, 8 bytes per other value."""
    width = F.lit(16)
    for field in df.schema.fields:
        if field.dataType.typeName() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif field.dataType.typeName() in ("struct", "array", "map"):
            width = width + F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0))
        else:
            width = width + F.lit(8)
    return width.cast("long")


def measured_bytes(df: DataFrame) -> int:
    """Size of a dimension from its own rows."""
    return df.agg(F.sum(_width(df))).first()[0] or 0


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= max_bytes


def measured(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A dimension for a join: broadcast if its rows measure small, else merged.

    Spark's own guess comes from the compressed size of files and may send a table of millions of
    rows through the driver.
    """
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df.hint("merge")


def lookup_left(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    broadcast: bool | None = None,
) -> DataFrame:
    """Left join to a dimension that is unique on ``keys``; every fact row is kept.

    A dimension measured below ``max_bytes`` is broadcast, so the facts do not move.
    A larger one is shuffled; a key that holds a large share of the facts is spread
    over ``salts`` tasks. The salt comes from the row itself, so a task that is run
    again after an executor loss sends its rows to the same place.
    """
    if broadcast is None:
        broadcast = fits_broadcast(dim, max_bytes)
    if broadcast:
        return facts.join(F.broadcast(dim), keys, "left")
    hashed = [c for c, kind in facts.dtypes if "map<" not in kind]  # maps have no hash
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    spread = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread.hint("merge"), keys + ["_salt"], "left").drop("_salt")


def keep_known(facts: DataFrame, dim: DataFrame, keys: list[str], max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Fact rows whose keys the dimension has; broadcast only if it measures small."""
    known = dim.select(*keys).distinct()
    return facts.join(measured(known, max_bytes), keys, "left_semi")


# How a prefix is keyed for a probe. MAPPED: an IPv4 prefix. TOP: an IPv6 prefix that
# lies in the first 57 bits. Both fit one number with their length. WIDE: all others.
MAPPED, TOP, WIDE = 4, 6, 0
TOP_BITS = 57
V4_BITS = 96


# Prefixes are filed under lengths that are multiples of this; a shorter one is filed once for
# each value of the bits it leaves open, at most 128 times. So an address is looked up for a few
# lengths only (four for IPv4, sixteen for IPv6), however many lengths the prefixes have.
STRIDE = 8


@dataclass(frozen=True)
class PrefixTable:
    """An IP-prefix dimension: ``hi``, ``lo`` (64-bit halves), ``plen`` (the length it is filed
    under) and attributes; one row per key."""

    rows: DataFrame
    attributes: tuple[str, ...]
    kinds: tuple[tuple[int, int], ...]
    small: bool

    @staticmethod
    def of(prefixes: DataFrame, attributes: list[str], max_bytes: int = BROADCAST_BYTES) -> PrefixTable:
        """From rows ``prefix`` (16 bytes), ``plen`` and the attributes.

        Bits after the length are cleared. Of rows with the same prefix and length the greatest
        attributes stay, so a flow meets one row at most. Rows that are no prefix are left out.
        """
        hi, lo = words(F.col("prefix"))
        rows = prefixes.select(hi.alias("hi"), lo.alias("lo"), F.col("plen").cast("int").alias("plen"), F.struct(*attributes).alias("attributes"))
        rows = rows.where(F.col("hi").isNotNull() & F.col("plen").between(0, 128))
        rows = rows.withColumns({"hi": F.col("hi").bitwiseAND(_keep_column(F.col("plen"))), "lo": F.col("lo").bitwiseAND(_keep_column(F.col("plen") - 64))})
        mapped = (F.col("hi") == 0) & (F.shiftrightunsigned("lo", 32) == 0xFFFF) & (F.col("plen") >= V4_BITS)
        filed = (F.ceil(F.col("plen") / STRIDE) * STRIDE).cast("int")
        top = (filed <= TOP_BITS) & (F.col("hi") != 0)
        rows = rows.withColumns({"kind": F.when(mapped, MAPPED).when(top, TOP).otherwise(WIDE), "filed": filed})
        open_bits = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, filed - plen) - 1")))
        rows = rows.withColumn("bits", open_bits)
        rows = rows.withColumns(
            {
                "hi": F.when(F.col("filed") <= 64, F.col("hi").bitwiseOR(F.expr("shiftleft(bits, 64 - filed)"))).otherwise(F.col("hi")),
                "lo": F.when(F.col("filed") > 64, F.col("lo").bitwiseOR(F.expr("shiftleft(bits, 128 - filed)"))).otherwise(F.col("lo")),
            }
        )
        longest = rows.groupBy("hi", "lo", "kind", "filed").agg(F.max(F.struct("plen", "attributes")).alias("best"))
        rows = longest.select("hi", "lo", F.col("filed").alias("plen"), "kind", "best.attributes.*")
        # At most 17 lengths of three kinds exist, so this list is bounded by the data type.
        sizes = rows.groupBy("kind", "plen").agg(F.sum(_width(rows)).alias("bytes")).collect()
        kinds = sorted(((r["kind"], r["plen"]) for r in sizes), key=lambda x: -x[1])
        return PrefixTable(rows, tuple(attributes), tuple(kinds), sum(r["bytes"] for r in sizes) <= max_bytes)

    @property
    def lengths(self) -> list[int]:
        return sorted({n for _, n in self.kinds}, reverse=True)

    def probes(self) -> list[dict[int, int]]:
        """Lengths to try by kind, longest first. An address is IPv4 or IPv6, so one probe
        can serve a length of each; not so where wide prefixes cover both families."""
        if any(kind == WIDE for kind, _ in self.kinds):
            return [{kind: n} for kind, n in self.kinds]
        by_kind = {k: [n for kind, n in self.kinds if kind == k] for k in (MAPPED, TOP)}
        pairs = zip_longest(by_kind[MAPPED], by_kind[TOP])
        return [{k: n for k, n in ((MAPPED, n4), (TOP, n6)) if n is not None} for n4, n6 in pairs]


def with_words(facts: DataFrame, ip: str) -> DataFrame:
    """Add the numbers that probes of ``ip`` are made from; they serve several tables."""
    if f"_v4_{ip}" in facts.columns:
        return facts
    hi, lo = words(F.col(ip))
    split = facts.withColumns({f"_hi_{ip}": hi, f"_lo_{ip}": lo})
    high, low = F.col(f"_hi_{ip}"), F.col(f"_lo_{ip}")
    return split.withColumn(f"_v4_{ip}", (high == 0) & (F.shiftrightunsigned(low, 32) == 0xFFFF))


def longest_prefix(
    facts: DataFrame,
    ip: str,
    table: PrefixTable,
    out: dict[str, str],
    strategy: str = "auto",
) -> DataFrame:
    """Attach the attributes of the longest prefix that covers ``ip`` (NULL if none).

    ``out`` maps attribute to output column. ``probe``: lookups by equality, longest prefix
    first; the facts are not shuffled if the table is small enough to broadcast.
    ``distinct``: each distinct address is resolved once and joined back. Both give the same
    rows. ``auto`` probes unless the table is large; a stream always probes, because it
    can't be joined to its own distinct addresses.
    """
    if strategy == "auto":
        strategy = "probe" if table.small or facts.isStreaming else "distinct"
    if strategy == "probe":
        return _probe(facts, ip, table, out)
    resolved = resolve_addresses(facts.select(F.col(ip).alias("_ip")), {"hit": table})
    picked = resolved.select(F.col("_ip").alias(ip), *[F.col(f"hit.{a}").alias(c) for a, c in out.items()])
    # As many rows as there are addresses: too large to copy per salt. A hot address is
    # split by the adaptive skew join instead.
    return facts.join(picked, ip, "left")


def _compact(top: Column, kind: int, plen: int) -> Column:
    """Masked leading bits with the length in the low 7 bits: 0..57 IPv6, 64..96 IPv4."""
    bits, code = (plen - V4_BITS, 64 + plen - V4_BITS) if kind == MAPPED else (plen, plen)
    return top.bitwiseAND(_keep(bits)).bitwiseOR(F.lit(code).cast("long"))


def _probe(facts: DataFrame, ip: str, table: PrefixTable, out: dict[str, str]) -> DataFrame:
    result = with_words(facts, ip)
    high, low, v4 = F.col(f"_hi_{ip}"), F.col(f"_lo_{ip}"), F.col(f"_v4_{ip}")
    hit = F.struct(*table.attributes).alias("_hit")
    leading = F.when(F.col("kind") == MAPPED, F.shiftleft("lo", 32)).otherwise(F.col("hi"))
    code = F.when(F.col("kind") == MAPPED, F.col("plen") - (V4_BITS - 64)).otherwise(F.col("plen")).cast("long")
    # All probes read the same broadcast, because the prefix length is part of the key.
    sent = F.broadcast if table.small else lambda rows: rows
    compact = sent(table.rows.where(F.col("kind") != WIDE).select(leading.bitwiseOR(code).alias("_key"), hit))
    wide = sent(
        table.rows.where(F.col("kind") == WIDE).select(
            F.col("hi").alias("_k1"), F.col("lo").alias("_k2"), F.col("plen").alias("_k3"), hit
        )
    )
    names = []
    for i, probe in enumerate(table.probes()):
        names.append(f"_hit{i}")
        if WIDE in probe:
            plen = probe[WIDE]
            on = (_masked(high, 0, plen) == F.col("_k1")) & (_masked(low, 1, plen) == F.col("_k2")) & (F.col("_k3") == plen)
            side = wide
        else:
            of4 = _compact(F.shiftleft(low, 32), MAPPED, probe[MAPPED]) if MAPPED in probe else F.lit(None).cast("long")
            of6 = _compact(high, TOP, probe[TOP]) if TOP in probe else F.lit(None).cast("long")
            on = F.when(v4, of4).otherwise(of6) == F.col("_key")
            side = compact
        result = result.join(side.withColumnRenamed("_hit", names[-1]), on, "left").drop("_key", "_k1", "_k2", "_k3")
    if names:
        best = F.coalesce(*names)
        values = {c: best.getField(a) for a, c in out.items()}
    else:
        types = dict(table.rows.dtypes)
        values = {c: F.lit(None).cast(types[a]) for a, c in out.items()}
    return result.withColumns(values).drop(*names)


def _keep(bits: int) -> Column:
    """A 64-bit mask with the first ``bits`` bits set."""
    mask = ((1 << bits) - 1) << (64 - bits)
    return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")


def _keep_column(bits: Column) -> Column:
    """The same for a column of lengths; a length outside 0..64 counts as the nearest bound."""
    cut = F.greatest(F.lit(0), F.least(F.lit(64), bits)).cast("int")
    # A shift by 64 is a shift by nothing, so no bits at all is a case of its own.
    return F.when(cut == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(64) - cut))


def _masked(word: Column, half: int, plen: int) -> Column:
    """One half of an address with the bits after ``plen`` cleared."""
    bits = min(max(plen - 64 * half, 0), 64)
    return word if bits == 64 else word.bitwiseAND(_keep(bits))


def resolve_addresses(addresses: DataFrame, tables: dict[str, PrefixTable]) -> DataFrame:
    """One row per distinct ``_ip`` with one struct column per prefix table.

    Each address becomes one candidate per prefix length in use, the candidates meet
    the table in an equi-join, and ``max_by`` keeps the longest. All steps combine on
    the map side, so an address that fills a third of the facts counts once per task.
    """
    hi, lo = words(F.col("_ip"))
    unique = addresses.where(F.octet_length("_ip") == 16).distinct().select("_ip", hi.alias("_hi"), lo.alias("_lo"))
    result = unique
    for name, table in tables.items():
        candidates = unique.select(
            "_ip",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(n).alias("plen"), _masked(F.col("_hi"), 0, n).alias("hi"), _masked(F.col("_lo"), 1, n).alias("lo"))
                        for n in table.lengths
                    ]
                )
            ).alias("c"),
        ).select("_ip", "c.*")
        rows = table.rows.drop("kind")
        rows = F.broadcast(rows) if table.small else rows
        hit = (
            candidates.join(rows, ["hi", "lo", "plen"])
            .groupBy("_ip")
            .agg(F.max_by(F.struct(*table.attributes), F.col("plen")).alias(name))
        )
        result = result.join(hit, "_ip", "left")
    return result.drop("_hi", "_lo")
