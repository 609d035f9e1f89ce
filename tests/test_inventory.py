"""Landed inventory pages and the targets made from an inventory."""

import json

import pytest

from netweir.operators import targets as tg
from netweir.sources import inventory as inv
from netweir.sources import tables


def pages(spark, *bodies):
    return spark.createDataFrame([(f"{i:04d}", b) for i, b in enumerate(bodies)], "page string, value string")


def page(*results):
    return json.dumps({"count": len(results), "next": None, "previous": None, "results": list(results)})


def device(i, address="10.0.0.1/32", **more):
    return {"id": i, "name": f"d{i}", "primary_ip": {"address": address}, **more}


def test_two_pages_and_cidr(spark):
    got = inv.devices(pages(spark, page(device(1)), page(device(2, "10.0.0.2/24")))).collect()
    assert {(r.mgmt_text, r.name) for r in got} == {("10.0.0.1", "d1"), ("10.0.0.2", "d2")}


def test_without_address_is_skipped_and_nulls_are_empty(spark):
    got = inv.devices(pages(spark, page({"id": 1, "name": "x", "primary_ip": None}, device(2, site=None)))).collect()
    assert [(r.name, r.site, r.region, r.role) for r in got] == [("d2", "", "", "")]


def test_bad_element_is_skipped(spark):
    got = inv.devices(pages(spark, page("just text", device(2, site={"name": "dc1"})))).collect()
    assert [(r.name, r.site) for r in got] == [("d2", "dc1")]


def test_bad_page_fails_the_load(spark):
    with pytest.raises(Exception, match="MALFORMED|malformed|parse|PARSE"):
        inv.devices(pages(spark, page(device(1)), "{invalid json")).collect()


def test_last_device_of_an_address_wins(spark):
    got = inv.devices(pages(spark, page(device(5), device(4)), page(device(3)))).collect()
    assert [r.name for r in got] == ["d3"]


def test_snmp_index_rules(spark):
    cases = [
        ({"snmp_index": 1}, "", 1), (None, "2", 2), (None, "42", 42), (None, "mgmt", None), (None, "", None),
        (None, " 7 up", 7), (None, "-3", None), ({"snmp_index": 0}, "9", None), ({"snmp_index": None}, "5", 5),
    ]
    results = [
        {"id": i, "name": f"i{i}", "speed": None, "custom_fields": c, "label": t} for i, (c, t, _) in enumerate(cases)
    ]
    df = spark.createDataFrame([(1, "p", page(*results))], "device_id bigint, page string, value string")
    got = {r.name: r.snmp_index for r in inv.interfaces(df).collect()}
    assert got == {f"i{i}": want for i, (_, _, want) in enumerate(cases) if want is not None}


def test_read_pages_from_files(spark, tmp_path):
    (tmp_path / "p1.json").write_text(page(device(1)))
    (tmp_path / "p2.json").write_text(page(device(2, "10.0.0.2")))
    assert inv.devices(inv.read_pages(spark, str(tmp_path))).count() == 2


FIELDS = "gnmi_enabled boolean, gnmi_port int, snmp_enabled boolean, snmp_module string, blackbox_probes array<string>"
SCHEMA = f"""id bigint, name string, primary_ip_address string, site string, region string, role string, platform string,
    manufacturer string, status string, custom_fields struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>,
    telemetry_profile string, monitoring_tier string"""


@pytest.fixture(scope="module")
def fleet(spark):
    rows = [
        (1, "router-1", "10.0.0.1", "dc1", "us-east", "core", "eos", "arista", "active",
         (True, 6030, True, "arista_sw", ["icmp", "tcp_connect"]), "", "premium"),
        (2, "switch-1", "10.0.0.2", "dc2", "eu-west", "access", "nxos", "cisco", "active",
         (False, 0, True, "cisco_nxos", ["icmp"]), "", "standard"),
        (3, "no-ip-device", "", "dc1", "us-east", "fw", "panos", "paloalto", "active",
         (True, 0, True, "", []), "", ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_target_counts(spark, fleet):
    assert tg.gnmi_targets(fleet).count() == 1
    assert tg.snmp_targets(fleet).count() == 2
    assert tg.probe_targets(fleet).count() == 3
    empty = fleet.where("id > 99")
    assert [f(empty).count() for f in (tg.gnmi_targets, tg.snmp_targets, tg.probe_targets)] == [0, 0, 0]
    assert tuple(tg.sync_stats(fleet).first()) == (3, 1, 2, 3)


def test_labels_and_subscriptions(spark, fleet):
    gnmi = tg.gnmi_targets(fleet).first()
    assert gnmi.target_key == "router-1:6030" and gnmi.address == "10.0.0.1:6030"
    assert gnmi.subscriptions == ["default-counters", "default-system", "default-bgp"]
    labels = tg.snmp_targets(fleet).where("labels['device'] = 'router-1'").first().labels
    assert labels == {
        "device": "router-1", "site": "dc1", "region": "us-east", "vendor": "arista", "platform": "eos",
        "role": "core", "tier": "premium", "__param_module": "arista_sw",
    }


def test_ports_profiles_and_duplicates(spark, fleet):
    from pyspark.sql import functions as F

    one = fleet.where("id = 1")
    other = one.withColumn("id", F.lit(9).cast("bigint")).withColumn("primary_ip_address", F.lit("10.9.9.9"))
    moved = one.withColumn("custom_fields", F.col("custom_fields").withField("gnmi_port", F.lit(57400)))
    got = tg.gnmi_targets(one.unionByName(other).unionByName(moved.withColumn("telemetry_profile", F.lit("deep")))).collect()
    assert {(r.target_key, r.address, r.subscriptions[-1]) for r in got} == {
        ("router-1:6030", "10.9.9.9:6030", "default-bgp"), ("router-1:57400", "10.0.0.1:57400", "deep"),
    }


def test_probe_shapes(spark, fleet):
    from pyspark.sql import functions as F

    probes = F.array(*[F.lit(p) for p in ("icmp", "tcp_connect", "http_2xx", "dns")])
    one = fleet.where("id = 1").withColumn("custom_fields", F.col("custom_fields").withField("blackbox_probes", probes))
    assert {r.probe: r.targets for r in tg.probe_targets(one).collect()} == {
        "icmp": ["10.0.0.1"], "tcp_connect": ["10.0.0.1:22"], "http_2xx": ["https://10.0.0.1"], "dns": ["10.0.0.1"],
    }
    none = fleet.where("id = 1").withColumn("custom_fields", F.col("custom_fields").withField("blackbox_probes", F.array().cast("array<string>")))
    assert [r.probe for r in tg.probe_targets(none).collect()] == ["icmp"]


@pytest.mark.parametrize(
    "vendor,platform,module",
    [
        ("arista", "eos", "arista_eos"), ("cisco", "iosxe", "cisco_iosxe"), ("cisco", "nxos", "cisco_nxos"),
        ("cisco", "ios", "cisco_ios"), ("juniper", "junos", "juniper_junos"), ("paloalto", "panos", "paloalto_panos"),
        ("unknown", "x", "if_mib"), ("", "", "if_mib"),
    ],
)
def test_module_matrix(spark, vendor, platform, module):
    from pyspark.sql import functions as F

    assert spark.range(1).select(tg.snmp_module(F.lit(vendor), F.lit(platform))).first()[0] == module


def test_empty_content_never_replaces(spark, fleet, tmp_path):
    path = str(tmp_path / "targets")
    probes = tg.probe_targets(fleet)
    assert tables.write_targets(probes, path)
    assert not tables.write_targets(probes.where("probe = 'none'"), path)
    assert spark.read.json(path).count() == 3
    assert tables.write_targets(probes.where("probe = 'icmp'"), path)
    assert spark.read.json(path).count() == 2


def test_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 4), ("d", 5)], "name string, v int")
    assert {(r.name, r.change) for r in tg.target_diff(old, new, "name").collect()} == {
        ("a", "removed"), ("c", "changed"), ("d", "added"),
    }
