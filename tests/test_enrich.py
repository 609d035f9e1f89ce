"""Lookup cases of the flow enrichment."""

import pytest
from pyspark.sql import functions as F

from netweir.operators.enrich import Dimensions, enrich, enrich_interfaces
from netweir.operators.joins import PrefixTable
from netweir.sources.flows import skip_undecoded, to_canonical
from netweir.schema import FLOW_COLUMNS


def v4(text):
    return bytes(int(x) for x in text.split("."))


def mapped(text):
    return bytes(10) + b"\xff\xff" + v4(text)


@pytest.fixture(scope="module")
def dims(spark):
    device = spark.createDataFrame(
        [(0x0A000001, "router-1", "dc1", "us-east", "core-router"), (0x0A000002, "switch-1", "dc2", "eu-west", "access")],
        "mgmt_ip bigint, name string, site string, region string, role string",
    )
    interface = spark.createDataFrame(
        [(0x0A000001, 1, "Ethernet1", 10000), (0x0A000001, 2, "Ethernet2", 25000), (0x01010101, 1, "orphan", 1)],
        "mgmt_ip bigint, snmp_index bigint, name string, speed bigint",
    )
    geo = spark.createDataFrame(
        [(mapped("8.0.0.0"), 104, "US", "Ashburn"), (mapped("8.8.8.0"), 120, "CA", "Toronto")],
        "prefix binary, plen int, country string, city string",
    )
    asn = spark.createDataFrame([(mapped("8.8.8.0"), 120, 15169, "EXAMPLE")], "prefix binary, plen int, asn bigint, as_name string")
    return Dimensions(device, interface, PrefixTable.of(geo, ["country", "city"]), PrefixTable.of(asn, ["asn", "as_name"]))


def flow(spark, **fields):
    kinds = {"src_ip": "binary", "dst_ip": "binary", "src_country": "string", "exporter_name": "string"}
    schema = ", ".join(f"{k} {kinds.get(k, 'bigint')}" for k in fields)
    return to_canonical(spark.createDataFrame([tuple(fields.values())], schema))


def test_hit_fills_everything(spark, dims):
    row = enrich(flow(spark, exporter_ip=0x0A000001, in_if=1, out_if=2), dims).first()
    assert (row.exporter_name, row.exporter_site, row.exporter_region, row.exporter_role) == (
        "router-1", "dc1", "us-east", "core-router",
    )
    assert (row.in_if_name, row.in_if_speed, row.out_if_name, row.out_if_speed) == ("Ethernet1", 10000, "Ethernet2", 25000)


def test_interface_miss_keeps_device(spark, dims):
    row = enrich(flow(spark, exporter_ip=0x0A000002, in_if=99, out_if=100), dims).first()
    assert (row.exporter_name, row.in_if_name, row.out_if_name) == ("switch-1", "", "")


def test_device_miss_keeps_the_flow_and_skips_interfaces(spark, dims):
    rows = enrich(flow(spark, exporter_ip=0x01010101, in_if=1, exporter_name="given"), dims).collect()
    assert len(rows) == 1
    assert (rows[0].exporter_name, rows[0].exporter_site, rows[0].in_if_name) == ("given", "", "")


def test_no_geo_table_leaves_countries(spark, dims):
    bare = Dimensions(dims.device, dims.interface)
    row = enrich(flow(spark, src_ip=v4("8.8.8.8"), dst_ip=v4("1.1.1.1"), src_country="kept"), bare).first()
    assert (row.src_country, row.dst_country) == ("kept", "")


def test_geo_longest_prefix_and_overwrite(spark, dims):
    row = enrich(flow(spark, src_ip=v4("8.8.8.8"), dst_ip=v4("8.1.1.1"), src_country="old"), dims).first()
    assert (row.src_country, row.src_city, row.dst_country) == ("CA", "Toronto", "US")
    row = enrich(flow(spark, src_ip=v4("9.9.9.9"), src_country="old"), dims).first()
    assert row.src_country == ""


def test_empty_address_skips_the_lookup(spark, dims):
    row = enrich(flow(spark, src_ip=b"", src_country="old"), dims).first()
    assert (row.src_country, row.src_as, row.src_as_name) == ("old", 0, "")


def test_as_number_only_filled_when_zero(spark, dims):
    row = enrich(flow(spark, src_ip=v4("8.8.8.8"), dst_ip=v4("8.8.8.9"), src_as=64500), dims).first()
    assert (row.src_as, row.src_as_name, row.dst_as, row.dst_as_name) == (64500, "EXAMPLE", 15169, "EXAMPLE")


def test_probe_and_distinct_agree(spark, dims):
    flows = flow(spark, src_ip=v4("8.8.8.8"), dst_ip=v4("8.1.1.1")).unionByName(flow(spark, src_ip=b"", dst_ip=v4("7.7.7.7")))
    key = lambda r: tuple(map(str, r))
    assert sorted(enrich(flows, dims, "probe").collect(), key=key) == sorted(enrich(flows, dims, "distinct").collect(), key=key)


def test_defaults_are_never_null(spark):
    row = flow(spark, exporter_ip=1).first()
    assert row.asDict().keys() == set(FLOW_COLUMNS)
    assert all(value is not None for value in row)
    assert (row.flow_type, row.direction) == ("unknown", "unknown")


def test_unknown_codes_become_unknown(spark):
    row = flow(spark, flow_type=77, direction=9).first()
    assert (row.flow_type, row.direction) == ("unknown", "unknown")


def test_undecoded_messages_are_skipped(spark):
    decoded = spark.sql("SELECT 1 AS offset, named_struct('bytes', 5L) AS flow UNION ALL SELECT 2, NULL")
    assert [tuple(r) for r in skip_undecoded(decoded).collect()] == [(1, 5)]


def interface_cases(spark, repeated):
    device = spark.range(40).select(F.col("id").alias("mgmt_ip"), F.concat(F.lit("r"), "id").alias("name"), F.lit("s").alias("site"), F.lit("g").alias("region"), F.lit("e").alias("role"))
    index = F.explode(F.expr("array(-3L, 0L, 1L, 63L, 64L, 200L, 4294967295L, NULL)"))
    interface = spark.range(45).select(F.when(F.col("id") > 0, F.col("id")).alias("mgmt_ip"), index.alias("snmp_index")).select(
        "mgmt_ip", "snmp_index", F.when(F.col("snmp_index") != 63, F.concat(F.lit("Eth"), F.col("snmp_index") % 5)).alias("name"), (F.col("mgmt_ip") % 3).alias("speed")
    )
    if repeated:
        interface = interface.unionByName(interface.where("mgmt_ip = 7"))
    wire = spark.range(50 * 9).select(
        (F.col("id") % 50).alias("exporter_ip"), F.expr("element_at(array(-3L, 0L, 1L, 2L, 63L, 64L, 65L, 200L, 4294967295L), cast(id % 9 as int) + 1)").alias("in_if"),
        F.expr("element_at(array(4294967295L, 64L, 5L, 0L), cast(id % 4 as int) + 1)").alias("out_if"), F.lit("own").alias("in_if_name"),
    )
    return to_canonical(wire), device, interface


@pytest.mark.parametrize("repeated", [False, True])
def test_interfaces_too_large_to_send_give_the_same_rows(spark, repeated):
    """By codes in blocks of indexes, where each index comes once; else by joins as before."""
    flows, device, interface = interface_cases(spark, repeated)
    columns = ["exporter_ip", "in_if", "out_if", "in_if_name", "in_if_speed", "out_if_name", "out_if_speed"]
    found = [sorted(map(tuple, enrich_interfaces(flows, device, interface, sent).select(*columns).collect())) for sent in (True, False)]
    assert found[0] == found[1] and (len(found[0]) > 450 if repeated else len(found[0]) == 450)
    plan = enrich_interfaces(flows, device, interface, False)._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) == repeated
