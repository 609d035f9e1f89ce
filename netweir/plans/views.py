"""Telemetry views over the test tables, as DataFrames.

The test tables hold orders and events, not network data. These views read every row
of them as flows, devices, prefixes, scrapes and remediation runs, so each query below
grows with the tables. ``views_sql`` states the same mapping in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweir.functions.ip import V4_MAPPED, binary_to_text
from netweir.operators.enrich import Dimensions
from netweir.operators.joins import PrefixTable
from netweir.sources.flows import to_canonical
from netweir.sources.tables import spread

NET10 = 167_772_160


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


# ---------------------------------------------------------------- flows

def lineitem_wire(li: DataFrame) -> DataFrame:
    """Line items as wire records; works on a stream of lineitem rows as well."""
    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    v6 = F.col("l_tax") > 0.075

    def address(net: Column, host: Column) -> Column:
        v4 = (F.lit(16_777_216) * (1 + net % 100) + host % 16_777_216).cast("long")
        wide = F.concat(F.lit("20010DB8"), _hex(net % 65_536, 4), F.lit("0" * 12), _hex(host, 8))
        return F.unhex(F.when(v6, wide).otherwise(_hex(v4, 8)))

    line = F.col("l_linenumber")
    return li.select(
        (F.unix_millis(F.col("l_shipdate").cast("timestamp")) + (F.col("l_orderkey") % 86_400) * 1000).alias(
            "timestamp_ms"
        ),
        (line % 5).cast("int").alias("flow_type"),
        (NET10 + supp).alias("exporter_ip"),
        line.cast("long").alias("in_if"),
        (1 + part % 8).alias("out_if"),
        address(supp, part).alias("src_ip"),
        address(part, supp).alias("dst_ip"),
        F.when(v6, 6).otherwise(4).alias("ip_version"),
        F.when(line % 3 == 0, 6).when(line % 3 == 1, 17).otherwise(1).alias("protocol"),
        (1024 + part % 1000).cast("int").alias("src_port"),
        F.when(line == 1, 80).when(line == 2, 443).when(line == 3, 53).when(line == 4, 22)
        .when(line == 5, 179).when(line == 6, 123).otherwise(8080).alias("dst_port"),
        F.col("l_quantity").cast("int").alias("tcp_flags"),
        cents("l_extendedprice").alias("bytes"),
        F.col("l_quantity").cast("long").alias("packets"),
        F.when(F.col("l_linestatus") == "O", 1000).otherwise(1).cast("long").alias("sampling_rate"),
        F.when(supp % 10 == 0, 0).otherwise(64_500 + supp % 20).cast("long").alias("src_as"),
        F.when(part % 10 == 0, 0).otherwise(64_500 + part % 20).cast("long").alias("dst_as"),
        (NET10 + part % 256).alias("next_hop"),
        (line * 100).cast("int").alias("src_vlan"),
        (line * 100 + 1).cast("int").alias("dst_vlan"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("direction"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(to_canonical(lineitem_wire(table(spark, sf_dir, "lineitem"))))


BUSY_MS = 6 * 3_600_000


def event_wire(events: DataFrame) -> DataFrame:
    """Events as wire records: four talkers in one busy minute every six hours, so several
    flows meet in every row of a rollup."""
    user, event = F.col("user_id"), F.col("event_id")
    kind = F.col("event_type")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(
        (ms - F.pmod(ms, F.lit(BUSY_MS)) + event % 30 * 1000).alias("timestamp_ms"),
        F.lit(3).alias("flow_type"),
        (NET10 + user).alias("exporter_ip"),
        (1 + event % 2).alias("in_if"),
        (1 + event % 3).alias("out_if"),
        F.unhex(_hex((16_777_216 * (1 + user % 2)).cast("long"), 8)).alias("src_ip"),
        F.unhex(_hex((16_777_216 * (1 + event % 2)).cast("long"), 8)).alias("dst_ip"),
        F.lit(4).alias("ip_version"),
        F.when(kind == "error", 1).when(kind == "click", 6).otherwise(17).alias("protocol"),
        F.lit(1024).alias("src_port"),
        F.when(kind == "view", 443).otherwise(53).alias("dst_port"),
        cents("value").alias("bytes"),
        (event % 7 + 1).alias("packets"),
    )


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_canonical(event_wire(table(spark, sf_dir, "events")))


def printable(df: DataFrame) -> DataFrame:
    """Addresses as text and times without a zone, for output."""
    for name, kind in df.dtypes:
        if kind == "binary":
            df = df.withColumn(name, binary_to_text(F.col(name)))
        elif kind == "timestamp":
            df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


# ---------------------------------------------------------------- dimensions

def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as devices; one with a negative balance has no management address."""
    return (
        suppliers(spark, sf_dir)
        .select(
            F.when(F.col("s_acctbal") >= 0, NET10 + F.col("s_suppkey")).alias("mgmt_ip"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("site"),
            F.col("r_name").alias("region"),
            F.when(F.col("s_suppkey") % 3 == 0, "core-router").when(F.col("s_suppkey") % 3 == 1, "edge")
            .otherwise("spine").alias("role"),
        )
        .where(F.col("mgmt_ip").isNotNull())
    )


def interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven interfaces per supplier; flows also use an eighth, which is unknown."""
    return table(spark, sf_dir, "supplier").select(
        (NET10 + F.col("s_suppkey")).alias("mgmt_ip"),
        F.explode(F.sequence(F.lit(1), F.lit(7))).alias("snmp_index"),
    ).select(
        "mgmt_ip",
        "snmp_index",
        F.concat(F.lit("Ethernet"), F.col("snmp_index")).alias("name"),
        (F.lit(1_000_000) * F.col("snmp_index")).cast("long").alias("speed"),
    )


def _v4_prefix(base: Column, length: int | Column) -> Column:
    plen = F.lit(length) if isinstance(length, int) else length
    return F.struct(
        F.unhex(F.concat(F.lit(V4_MAPPED), _hex(base.cast("long"), 8))).alias("prefix"),
        (F.lit(96) + plen).cast("int").alias("plen"),
    )


def _v6_prefix(text: Column, length: int) -> Column:
    return F.struct(F.unhex(F.rpad(text, 32, "0")).alias("prefix"), F.lit(length).alias("plen"))


def _with(prefix: Column, **attributes: Column) -> Column:
    return F.struct(
        prefix.getField("prefix").alias("prefix"),
        prefix.getField("plen").alias("plen"),
        *[v.alias(k) for k, v in attributes.items()],
    )


def geo(spark: SparkSession, sf_dir: str) -> PrefixTable:
    n = F.col("n_nationkey")

    def place(key: Column) -> dict[str, Column]:
        return {
            "country": F.concat(F.lit("N"), key.cast("string")),
            "city": F.concat(F.lit("City_"), key.cast("string")),
        }

    octet = (1 + 4 * n) * 16_777_216
    own = [_with(_v4_prefix(octet + i * 16_777_216, 8), **place(n)) for i in range(3)]
    overrides = [
        _with(_v4_prefix(octet, 16), **place((n + 1) % 25)),
        _with(_v4_prefix(octet + 16_777_216, 20), **place((n + 2) % 25)),
        _with(_v6_prefix(F.concat(F.lit("20010DB8"), _hex(n, 4)), 48), **place(n)),
    ]
    whole_v6 = F.when(n == 0, F.array(_with(_v6_prefix(F.lit("20010DB8"), 32), **place(F.lit(99)))))
    rows = table(spark, sf_dir, "nation").select(
        F.explode(F.concat(F.array(*own, *overrides), F.coalesce(whole_v6, F.array()))).alias("r")
    )
    return PrefixTable.of(rows.select("r.*"), ["country", "city"])


def asn(spark: SparkSession, sf_dir: str) -> PrefixTable:
    n = F.col("n_nationkey")
    octet = (1 + 4 * n) * 16_777_216
    name = F.concat(F.lit("AS-"), F.col("n_name"))
    entries = [
        _with(_v4_prefix(octet + i * 16_777_216, 8), asn=(65_000 + n).cast("long"), as_name=name) for i in range(4)
    ]
    entries.append(
        _with(
            _v4_prefix(octet + 3 * 16_777_216, 20),
            asn=(66_000 + n).cast("long"),
            as_name=F.concat(F.lit("EDGE-"), F.col("n_name")),
        )
    )
    rows = table(spark, sf_dir, "nation").select(F.explode(F.array(*entries)).alias("r"))
    return PrefixTable.of(rows.select("r.*"), ["asn", "as_name"])


def site_prefixes(spark: SparkSession, sf_dir: str) -> PrefixTable:
    n = F.col("n_nationkey")
    length = F.when(F.col("n_regionkey") == 4, 20).otherwise(8)
    entries = [
        _with(_v4_prefix((1 + 4 * n + i) * 16_777_216, length), site=F.col("n_name")) for i in range(4)
    ]
    rows = table(spark, sf_dir, "nation").select(F.explode(F.array(*entries)).alias("r"))
    return PrefixTable.of(rows.select("r.*"), ["site"])


def dimensions(spark: SparkSession, sf_dir: str) -> Dimensions:
    return Dimensions(
        device=devices(spark, sf_dir),
        interface=interfaces(spark, sf_dir),
        geo=geo(spark, sf_dir),
        asn=asn(spark, sf_dir),
    )
