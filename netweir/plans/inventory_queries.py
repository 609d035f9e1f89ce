"""Inventory and target queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweir.operators import targets as tg
from netweir.plans import views as v
from netweir.plans.registry import query
from netweir.plans.views_sql import VIEWS, sql
from netweir.sources import inventory as inv



def _address(number):
    """10.a.b.c of a device number."""
    parts = [F.floor(number / 65_536) % 256, F.floor(number / 256) % 256, number % 256]
    return F.concat(F.lit("10"), *[x for p in parts for x in (F.lit("."), p.cast("long").cast("string"))])


def _address_sql(number):
    return f"format('10.{{}}.{{}}.{{}}', ({number})//65536%256, ({number})//256%256, ({number})%256)"


def inventory(spark, sf):
    """Suppliers as inventory devices with nested settings."""
    k = F.col("s_suppkey")
    return v.suppliers(spark, sf).select(
        k.alias("id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") < 0, "").otherwise(_address(k)).alias("primary_ip_address"),
        F.col("n_name").alias("site"),
        F.col("r_name").alias("region"),
        F.when(k % 3 == 0, "core-router").when(k % 3 == 1, "edge").otherwise("spine").alias("role"),
        F.element_at(F.array(*[F.lit(x) for x in PLATFORMS]), (k % 4 + 1).cast("int")).alias("platform"),
        F.element_at(F.array(*[F.lit(x) for x in VENDORS]), (k % 6 + 1).cast("int")).alias("manufacturer"),
        F.lit("active").alias("status"),
        F.struct(
            (k % 2 == 0).alias("gnmi_enabled"),
            F.when(k % 4 == 0, 0).otherwise(57_400).alias("gnmi_port"),
            (k % 5 != 0).alias("snmp_enabled"),
            F.when(k % 3 == 0, "custom_mod").otherwise("").alias("snmp_module"),
            F.when(k % 4 == 1, F.array(F.lit("icmp"), F.lit("tcp_connect"))).when(k % 4 == 2, F.array(F.lit("http_2xx")))
            .when(k % 4 == 3, F.array(F.lit("icmp"), F.lit("dns"))).otherwise(F.array().cast("array<string>"))
            .alias("blackbox_probes"),
        ).alias("custom_fields"),
        F.when(k % 3 == 1, "bgp-heavy").otherwise("").alias("telemetry_profile"),
        F.when(k % 2 == 0, "premium").otherwise("standard").alias("monitoring_tier"),
    )


VENDORS = ["arista", "cisco", "juniper", "paloalto", "nokia", ""]
PLATFORMS = ["iosxe", "nxos", "ios", "eos"]
_MODULE = """CASE manufacturer WHEN 'arista' THEN 'arista_eos' WHEN 'juniper' THEN 'juniper_junos'
    WHEN 'paloalto' THEN 'paloalto_panos' WHEN 'cisco' THEN CASE platform WHEN 'iosxe' THEN 'cisco_iosxe'
    WHEN 'nxos' THEN 'cisco_nxos' ELSE 'cisco_ios' END ELSE 'if_mib' END"""
VIEWS["v_inventory"] = f"""
  SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal < 0 THEN '' ELSE {_address_sql('s_suppkey')} END
      AS primary_ip_address, n_name AS site, r_name AS region,
      CASE s_suppkey % 3 WHEN 0 THEN 'core-router' WHEN 1 THEN 'edge' ELSE 'spine' END AS role,
      {PLATFORMS}[s_suppkey % 4 + 1] AS platform, {VENDORS}[s_suppkey % 6 + 1] AS manufacturer,
      s_suppkey % 2 = 0 AS gnmi_enabled, CASE WHEN s_suppkey % 4 = 0 THEN 6030 ELSE 57400 END AS port,
      s_suppkey % 5 != 0 AS snmp_enabled, CASE WHEN s_suppkey % 3 = 0 THEN 'custom_mod' ELSE '' END AS snmp_module,
      CASE s_suppkey % 4 WHEN 1 THEN ['icmp', 'tcp_connect'] WHEN 2 THEN ['http_2xx'] WHEN 3 THEN ['icmp', 'dns']
          ELSE ['icmp'] END AS probes,
      CASE WHEN s_suppkey % 3 = 1 THEN 'bgp-heavy' ELSE '' END AS telemetry_profile,
      CASE WHEN s_suppkey % 2 = 0 THEN 'premium' ELSE 'standard' END AS monitoring_tier, s_acctbal
  FROM v_supplier"""
_LABELS = """'"device":"', name, '","platform":"', platform, '","region":"', region, '","role":"', role, '","site":"', site,
    '","tier":"', monitoring_tier, '","vendor":"', manufacturer, '"}'"""
VIEWS["v_gnmi"] = f"""
  SELECT name || ':' || port AS target_key, primary_ip_address || ':' || port AS address,
      concat('{{', {_LABELS}) AS labels,
      'default-counters,default-system,' || CASE WHEN telemetry_profile = '' THEN 'default-bgp' ELSE telemetry_profile END
          AS subscriptions
  FROM v_inventory WHERE gnmi_enabled AND primary_ip_address != ''"""
VIEWS["v_snmp"] = f"""
  SELECT primary_ip_address AS target, name,
      concat('{{"__param_module":"', CASE WHEN snmp_module = '' THEN {_MODULE} ELSE snmp_module END, '",', {_LABELS}) AS labels
  FROM v_inventory WHERE snmp_enabled AND primary_ip_address != ''"""
VIEWS["v_probe"] = """
  SELECT id, probe, CASE probe WHEN 'tcp_connect' THEN primary_ip_address || ':22'
        WHEN 'http_2xx' THEN 'https://' || primary_ip_address ELSE primary_ip_address END AS target,
      concat('{"__param_module":"', probe, '","device":"', name, '","region":"', region, '","site":"', site, '"}') AS labels
  FROM (SELECT *, unnest(probes) AS probe FROM v_inventory) WHERE primary_ip_address != ''"""


def _flat(targets):
    """Arrays and maps as text."""
    columns = {"labels": F.to_json("labels")}
    if "targets" in targets.columns:
        columns["targets"] = F.array_join("targets", ",")
    if "subscriptions" in targets.columns:
        columns["subscriptions"] = F.array_join("subscriptions", ",")
    flat = targets.withColumns(columns)
    return flat.withColumnRenamed("targets", "target") if "targets" in columns else flat


@query("targets_gnmi", sql("SELECT * FROM v_gnmi"))
def targets_gnmi(spark, sf):
    return _flat(tg.gnmi_targets(inventory(spark, sf)))


@query("targets_snmp", sql("SELECT target, labels FROM v_snmp"))
def targets_snmp(spark, sf):
    return _flat(tg.snmp_targets(inventory(spark, sf)))


@query("targets_blackbox", sql("SELECT * FROM v_probe"))
def targets_blackbox(spark, sf):
    return _flat(tg.probe_targets(inventory(spark, sf)))


@query("target_documents", sql("""
    SELECT probe, id // 500 AS part, count(*) AS target_count, '[' || string_agg(
        concat('{"targets":["', target, '"],"labels":', labels, '}'), ',' ORDER BY id) || ']' AS document
    FROM v_probe GROUP BY ALL"""))
def target_documents(spark, sf):
    return tg.target_documents(tg.probe_targets(inventory(spark, sf)))


@query("target_sync_stats", sql("""
    SELECT count(*) AS devices_total,
        count(*) FILTER (primary_ip_address != '' AND gnmi_enabled) AS gnmi_targets,
        count(*) FILTER (primary_ip_address != '' AND snmp_enabled) AS snmp_targets,
        CAST(sum(len(probes)) FILTER (primary_ip_address != '') AS BIGINT) AS blackbox_targets FROM v_inventory"""))
def target_sync_stats(spark, sf):
    return tg.sync_stats(inventory(spark, sf))


@query("target_sync_runs", sql("""
    WITH r AS (SELECT o_orderstatus != 'F' AS ok, o_orderdate + to_seconds(o_orderkey) AS started,
        o_orderdate + to_seconds(o_orderkey) + to_milliseconds(o_orderkey % 90000) AS finished FROM orders)
    SELECT max(finished) FILTER (ok) AS last_success_at,
        arg_max((epoch_us(finished) - epoch_us(started)) / 1000000.0E0, finished) FILTER (ok) AS last_duration_s,
        count(*) FILTER (NOT ok) AS errors_total, count(*) AS runs_total FROM r"""))
def target_sync_runs(spark, sf):
    """Orders as synchronisations: a failed order is a failed run."""
    started = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey"))
    finished = F.timestamp_micros(F.unix_micros(started) + F.col("o_orderkey") % 90_000 * 1000)
    runs = v.table(spark, sf, "orders").select(
        (F.col("o_orderstatus") != "F").alias("ok"), started.alias("started"), finished.alias("finished")
    )
    return tg.sync_runs(runs)


@query("snmp_module", sql(f"""
    SELECT manufacturer, platform, {_MODULE} AS module, count(*) AS devices FROM v_inventory GROUP BY ALL"""))
def snmp_module(spark, sf):
    return (
        inventory(spark, sf).groupBy("manufacturer", "platform").agg(F.count(F.lit(1)).alias("devices"))
        .withColumn("module", tg.snmp_module(F.col("manufacturer"), F.col("platform")))
    )


@query("target_diff", sql("""
    WITH o AS (SELECT name, '{"address":"' || primary_ip_address || '","tier":"' || monitoring_tier || '"}' AS before
        FROM v_inventory WHERE s_acctbal < 9000),
    n AS (SELECT name, '{"address":"' || primary_ip_address || '","tier":"'
        || CASE WHEN s_acctbal < 2000 THEN 'basic' ELSE monitoring_tier END || '"}' AS after
        FROM v_inventory WHERE primary_ip_address != '')
    SELECT name, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END
        AS change FROM o FULL JOIN n USING (name) WHERE before IS DISTINCT FROM after"""))
def target_diff(spark, sf):
    """Yesterday's inventory without the newest devices, today's with tiers changed."""
    balance = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    devices = inventory(spark, sf).join(balance, "id")
    old = devices.where(F.col("s_acctbal") < 9000).select(
        "name", F.col("primary_ip_address").alias("address"), F.col("monitoring_tier").alias("tier")
    )
    new = devices.where(F.col("primary_ip_address") != "").select(
        "name",
        F.col("primary_ip_address").alias("address"),
        F.when(F.col("s_acctbal") < 2000, "basic").otherwise(F.col("monitoring_tier")).alias("tier"),
    )
    return tg.target_diff(old, new, "name")


# ------------------------------------------------------------ landed inventory pages


def device_pages(spark, sf, sharing=1):
    """Suppliers as inventory JSON pages: some without address, some broken elements.

    With ``sharing`` above 1, that many neighbouring devices share one address.
    """
    k = F.col("s_suppkey")
    address = F.concat(_address(F.floor(k / sharing)), F.lit("/32"))
    named = lambda c: F.struct(F.col(c).alias("name"))
    element = F.to_json(
        F.struct(
            k.alias("id"),
            F.col("s_name").alias("name"),
            F.when(F.col("s_acctbal") >= 0, F.struct(address.alias("address"))).alias("primary_ip"),
            F.when(F.col("n_regionkey") != 2, named("n_name")).alias("site"),
            F.when(F.col("n_regionkey") != 3, named("r_name")).alias("region"),
            F.when(k % 3 == 0, F.struct(F.lit("core-router").alias("name"))).alias("role"),
        )
    )
    broken = F.when(F.col("s_acctbal") > 9500, F.lit('"not an object"')).otherwise(element)
    return inv.paged(v.suppliers(spark, sf), [], "s_suppkey", broken)


def _device_pages_sql(sharing):
    return f"""SELECT s_suppkey AS device_id, s_suppkey, {_address_sql(f's_suppkey // {sharing}')} AS mgmt_text,
        167772160 + s_suppkey // {sharing} AS mgmt_ip, s_name AS name,
        CASE WHEN n_regionkey != 2 THEN n_name ELSE '' END AS site,
        CASE WHEN n_regionkey != 3 THEN r_name ELSE '' END AS region,
        CASE WHEN s_suppkey % 3 = 0 THEN 'core-router' ELSE '' END AS role
        FROM v_supplier WHERE s_acctbal >= 0 AND s_acctbal <= 9500"""


@query("inventory_devices", sql(f"SELECT * EXCLUDE s_suppkey FROM ({_device_pages_sql(1)})"))
def inventory_devices(spark, sf):
    return inv.devices(device_pages(spark, sf))


@query("inventory_dedup", sql(f"""
    SELECT * EXCLUDE s_suppkey FROM ({_device_pages_sql(3)})
    QUALIFY row_number() OVER (PARTITION BY mgmt_ip ORDER BY s_suppkey DESC) = 1"""))
def inventory_dedup(spark, sf):
    return inv.devices(device_pages(spark, sf, 3))


def interface_pages(spark, sf):
    """Eight interfaces per supplier, with and without a usable SNMP index."""
    rows = v.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("device_id"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("i")
    )
    i = F.col("i")
    text = i.cast("string")
    element = F.to_json(
        F.struct(
            (F.col("device_id") * 10 + i).alias("id"),
            F.concat(F.lit("Ethernet"), text).alias("name"),
            F.when(i != 3, i * 1_000_000).alias("speed"),
            F.when(i.isin(1, 2, 3), F.struct(i.alias("snmp_index"))).when(i == 6, F.struct(F.lit(0).alias("snmp_index")))
            .alias("custom_fields"),
            F.when(i == 4, "4 uplink").when(i == 5, "mgmt").when(i == 7, "").when(i == 8, " 2").otherwise("99")
            .alias("label"),
        )
    )
    return inv.paged(rows.withColumn("n", i - 1), ["device_id"], "n", element)


@query("inventory_interfaces", sql("""
    SELECT s_suppkey AS device_id, idx AS snmp_index, name, speed FROM supplier, (VALUES
      (CAST(1 AS BIGINT), 'Ethernet1', CAST(1000000 AS BIGINT)), (2, 'Ethernet8', 8000000), (3, 'Ethernet3', 0),
      (4, 'Ethernet4', 4000000)) AS x(idx, name, speed)"""))
def inventory_interfaces(spark, sf):
    return inv.interfaces(interface_pages(spark, sf))
