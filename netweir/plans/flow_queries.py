"""Flow queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweir.functions import ip as ipf
from netweir.functions.timing import ntz
from netweir.operators import panels, rollup
from netweir.operators.enrich import enrich, enrich_asn, enrich_device, enrich_geo, enrich_interfaces, enrich_sites
from netweir.operators.joins import keep_known
from netweir.operators.ranges import RangeTable
from netweir.operators.rollup import retained
from netweir.plans import views as v
from netweir.plans.registry import query
from netweir.plans.views_sql import sql
from netweir.session import work_dir

# ------------------------------------------------------------ projections


CANONICAL_COLUMNS = [
    "ts", "flow_type", "exporter_ip", "in_if", "out_if", "src_ip", "dst_ip", "ip_version", "protocol", "src_port",
    "dst_port", "tcp_flags", "bytes", "packets", "sampling_rate", "src_as", "dst_as", "next_hop", "src_vlan",
    "dst_vlan", "direction", "exporter_site", "src_country", "in_if_speed",
]


@query("flow_canonical", sql("""
    SELECT ts, flow_type, exporter_ip, in_if, out_if, src_ip, dst_ip, ip_version, protocol, src_port, dst_port,
           tcp_flags, bytes, packets, sampling_rate, src_as, dst_as, next_hop, src_vlan, dst_vlan, direction,
           '' AS exporter_site, '' AS src_country, CAST(0 AS BIGINT) AS in_if_speed
    FROM v_flows"""))
def flow_canonical(spark, sf):
    return v.printable(v.flows(spark, sf)).select(*CANONICAL_COLUMNS)


@query("flow_time_filter", sql("""
    SELECT ts, exporter_ip, bytes, packets FROM v_flows
    WHERE ts BETWEEN TIMESTAMP '1996-03-01 00:00:00' AND TIMESTAMP '1998-09-02 12:00:00'"""))
def flow_time_filter(spark, sf):
    picked = panels.time_range(v.flows(spark, sf), "1996-03-01 00:00:00", "1998-09-02 12:00:00")
    return v.printable(picked.select("ts", "exporter_ip", "bytes", "packets"))


@query("ip_text", sql("""
    SELECT exporter_ip, format('10.{}.{}.{}', (exporter_ip//65536)%256, (exporter_ip//256)%256, exporter_ip%256)
           AS exporter_text, exporter_ip AS exporter_back,
           '00000000000000000000FFFF' || printf('%08X', exporter_ip) AS exporter_hex,
           src_hex, src_ip AS src_text, count(*) AS flow_count
    FROM v_flows GROUP BY ALL"""))
def ip_text(spark, sf):
    flows = v.flows(spark, sf).groupBy("exporter_ip", "src_ip").agg(F.count(F.lit(1)).alias("flow_count"))
    text = ipf.u32_to_text(F.col("exporter_ip"))
    return flows.select(
        "exporter_ip",
        text.alias("exporter_text"),
        ipf.text_to_u32(text).alias("exporter_back"),
        F.hex(ipf.u32_to_binary(F.col("exporter_ip"))).alias("exporter_hex"),
        F.hex("src_ip").alias("src_hex"),
        ipf.binary_to_text(F.col("src_ip")).alias("src_text"),
        "flow_count",
    )


@query("ip_network", sql("""
    SELECT DISTINCT src_ip, src_network,
        CASE WHEN ip_version = 4 THEN src_hex[1:28] || printf('%X', (CAST('0x' || src_hex[29:32] AS BIGINT) // 4096))
             || '000' ELSE src_hex[1:28] || printf('%X', CAST('0x' || src_hex[29:32] AS BIGINT) // 4096) || '000' END
             AS masked_116
    FROM v_flows"""))
def ip_network(spark, sf):
    distinct = v.flows(spark, sf).select("src_ip").distinct()
    return v.printable(
        distinct.withColumn("src_network", ipf.network(F.col("src_ip"))).withColumn(
            "masked_116", F.hex(ipf.mask(F.col("src_ip"), 116))
        )
    )


@query("strip_cidr", sql("""
    SELECT s_suppkey, s_name || '/' || (s_suppkey % 33) AS address, s_name AS stripped, s_name AS unchanged
    FROM supplier"""))
def strip_cidr(spark, sf):
    address = F.concat("s_name", F.lit("/"), (F.col("s_suppkey") % 33).cast("string"))
    return v.table(spark, sf, "supplier").select(
        "s_suppkey",
        address.alias("address"),
        ipf.strip_cidr(address).alias("stripped"),
        ipf.strip_cidr(F.col("s_name")).alias("unchanged"),
    )


@query("tcp_flag_names", sql("""
    SELECT tcp_flags, concat_ws(',', CASE WHEN tcp_flags & 1 > 0 THEN 'FIN' END, CASE WHEN tcp_flags & 2 > 0 THEN 'SYN' END,
           CASE WHEN tcp_flags & 4 > 0 THEN 'RST' END, CASE WHEN tcp_flags & 8 > 0 THEN 'PSH' END,
           CASE WHEN tcp_flags & 16 > 0 THEN 'ACK' END, CASE WHEN tcp_flags & 32 > 0 THEN 'URG' END) AS flag_names,
           CAST(sum(bytes) AS BIGINT) AS total_bytes
    FROM v_flows WHERE protocol = 6 GROUP BY tcp_flags"""))
def tcp_flag_names(spark, sf):
    return (
        v.flows(spark, sf).where("protocol = 6").groupBy("tcp_flags").agg(F.sum("bytes").alias("total_bytes"))
        .withColumn("flag_names", ipf.tcp_flag_names(F.col("tcp_flags")))
    )


@query("sampled_bytes", sql("""
    SELECT exporter_ip, CAST(sum(bytes * sampling_rate) AS BIGINT) AS total_bytes FROM v_flows GROUP BY exporter_ip"""))
def sampled_bytes(spark, sf):
    return panels.scaled_bytes(v.flows(spark, sf)).groupBy("exporter_ip").agg(F.sum("bytes").alias("total_bytes"))


# ------------------------------------------------------------ panels


def _panel(name, text, fn):
    @query(name, sql(text))
    def run(spark, sf):
        return v.printable(fn(v.flows(spark, sf)))


def _top_sql(keys, measures, order, limit=None, where="true", source="v_flows"):
    tail = f" LIMIT {limit}" if limit else ""
    return f"SELECT {keys}, {measures} FROM {source} WHERE {where} GROUP BY {keys} ORDER BY {order} DESC, {keys}{tail}"


_BYTES = "CAST(sum(bytes) AS BIGINT) AS total_bytes"
_PACKETS = "CAST(sum(packets) AS BIGINT) AS total_packets"
_COUNT = "count(*) AS flow_count"


def _top_ip_sql(side):
    return f"""SELECT {side}_ip, {_BYTES} FROM v_flows GROUP BY {side}_ip, {side}_hex
        ORDER BY total_bytes DESC, {side}_hex LIMIT 20"""


_panel("top_src_ips", _top_ip_sql("src"), panels.top_src_ips)
_panel("top_dst_ips", _top_ip_sql("dst"), panels.top_dst_ips)
_panel(
    "top_conversations",
    f"""SELECT src_ip, dst_ip, protocol, {_BYTES}, {_PACKETS} FROM v_flows
        GROUP BY src_ip, dst_ip, protocol, src_hex, dst_hex
        ORDER BY total_bytes DESC, src_hex, dst_hex, protocol LIMIT 50""",
    panels.top_conversations,
)
_panel("top_protocols", _top_sql("protocol", _BYTES, "total_bytes", 10), panels.top_protocols)
_panel("proto_bytes", _top_sql("protocol", _BYTES, "total_bytes"), panels.protocol_bytes)
_panel("proto_packets", _top_sql("protocol", _PACKETS, "total_packets"), panels.protocol_packets)
_panel("top_dst_ports", _top_sql("dst_port", _BYTES, "total_bytes", 20), lambda f: panels.top_ports(f, "dst"))
_panel("top_src_ports", _top_sql("src_port", _BYTES, "total_bytes", 20), lambda f: panels.top_ports(f, "src"))
_panel(
    "tcp_flags",
    _top_sql("tcp_flags", f"{_COUNT}, {_BYTES}", "flow_count", 16, "protocol = 6"),
    panels.tcp_flag_distribution,
)
_panel("top_src_asn", _top_sql("src_as", _BYTES, "total_bytes", 20, "src_as > 0"), lambda f: panels.top_asn(f, "src"))
_panel("top_dst_asn", _top_sql("dst_as", _BYTES, "total_bytes", 20, "dst_as > 0"), lambda f: panels.top_asn(f, "dst"))
_panel(
    "as_pairs",
    _top_sql("src_as, dst_as", f"{_BYTES}, {_PACKETS}, {_COUNT}", "total_bytes", 50, "src_as > 0 AND dst_as > 0"),
    panels.as_pairs,
)
_panel("as_matrix", _top_sql("src_as, dst_as", f"{_BYTES}, {_COUNT}", "total_bytes", 50), panels.as_matrix)
_panel(
    "transit_series",
    """SELECT time_bucket(INTERVAL '1 day', ts) AS time, CAST(sum(bytes) AS BIGINT) AS transit_bytes FROM v_flows
       WHERE src_as != dst_as AND src_as > 0 AND dst_as > 0 GROUP BY 1 ORDER BY 1""",
    lambda f: panels.transit_series(f, 86_400),
)


def _site_panel(name, text, fn):
    @query(name, sql(text))
    def run(spark, sf):
        return fn(enrich_sites(v.flows(spark, sf), v.site_prefixes(spark, sf)))


_SITED = """(SELECT f.*, coalesce(s.site, '') AS src_site, coalesce(d.site, '') AS dst_site FROM v_flows f
    LEFT JOIN v_site_prefix_hit s ON src_hex = s.ip LEFT JOIN v_site_prefix_hit d ON dst_hex = d.ip)"""
_site_panel(
    "site_matrix", _top_sql("src_site, dst_site", f"{_BYTES}, {_COUNT}", "total_bytes", source=_SITED),
    panels.site_matrix,
)
_site_panel(
    "proto_per_path",
    _top_sql("src_site, dst_site, protocol", _BYTES, "total_bytes", 50, source=_SITED),
    panels.protocol_per_path,
)


def _geo_panel(name, text, fn):
    @query(name, sql(text))
    def run(spark, sf):
        return fn(enrich_geo(v.flows(spark, sf), v.geo(spark, sf)))


_geo_panel(
    "country_map",
    _top_sql("src_country", _BYTES, "total_bytes", where="src_country != ''", source="v_flows_geo"),
    lambda f: panels.country_bytes(f, "src"),
)
for _side in ("src", "dst"):
    _geo_panel(
        f"top_{_side}_countries",
        _top_sql(f"{_side}_country", _BYTES, "total_bytes", 20, f"{_side}_country != ''", "v_flows_geo"),
        lambda f, side=_side: panels.country_bytes(f, side, 20),
    )
_geo_panel(
    "cross_border_series",
    """SELECT time_bucket(INTERVAL '1 day', ts) AS time, CAST(sum(bytes) AS BIGINT) AS cross_border_bytes
       FROM v_flows_geo WHERE src_country != dst_country AND src_country != '' AND dst_country != ''
       GROUP BY 1 ORDER BY 1""",
    lambda f: panels.cross_border_series(f, 86_400),
)

_IFACE_SQL = """SELECT time_bucket(INTERVAL '1 hour', ts) AS time, exporter_ip, in_if,
    CAST(sum(bytes) * 8 AS DOUBLE) / 3600 AS bits_per_sec FROM v_flows WHERE {where} GROUP BY 1, 2, 3"""


@query("iface_flow_bps", sql(_IFACE_SQL.format(where="exporter_ip IN (SELECT mgmt_ip FROM v_device)")))
def iface_flow_bps(spark, sf):
    known = v.devices(spark, sf).select(F.col("mgmt_ip").alias("exporter_ip"))
    flows = keep_known(v.flows(spark, sf), known, ["exporter_ip"])
    return panels.interface_bit_rate(flows, None, 3600)


@query("iface_flow_bps_selected", sql(_IFACE_SQL.format(where="exporter_ip IN (167772162, 167772165, 167772169)")))
def iface_flow_bps_selected(spark, sf):
    """The devices chosen in the dashboard's device list; choosing them is the feature."""
    return panels.interface_bit_rate(v.flows(spark, sf), [167772162, 167772165, 167772169], 3600)


# ------------------------------------------------------------ enrichment

_FLOW_KEY = "ts, exporter_ip, in_if, out_if, src_ip, dst_ip, bytes"


@query("enrich_device", sql(f"""
    SELECT {_FLOW_KEY}, exporter_name, exporter_site, exporter_region, exporter_role FROM v_enriched"""))
def q_enrich_device(spark, sf):
    out = enrich_device(v.flows(spark, sf), v.devices(spark, sf))
    return v.printable(
        out.select(
            "ts", "exporter_ip", "in_if", "out_if", "src_ip", "dst_ip", "bytes",
            "exporter_name", "exporter_site", "exporter_region", "exporter_role",
        )
    )


@query("enrich_interfaces", sql(f"""
    SELECT {_FLOW_KEY}, in_if_name, in_if_speed, out_if_name, out_if_speed FROM v_enriched"""))
def q_enrich_interfaces(spark, sf):
    out = enrich_interfaces(v.flows(spark, sf), v.devices(spark, sf), v.interfaces(spark, sf))
    return v.printable(
        out.select(
            "ts", "exporter_ip", "in_if", "out_if", "src_ip", "dst_ip", "bytes",
            "in_if_name", "in_if_speed", "out_if_name", "out_if_speed",
        )
    )


_GEO_SQL = sql(f"SELECT {_FLOW_KEY}, src_country, src_city, dst_country, dst_city FROM v_flows_geo")


def _geo_flows(spark, sf, strategy):
    out = enrich_geo(v.flows(spark, sf), v.geo(spark, sf), strategy)
    return v.printable(
        out.select(
            "ts", "exporter_ip", "in_if", "out_if", "src_ip", "dst_ip", "bytes",
            "src_country", "src_city", "dst_country", "dst_city",
        )
    )


@query("enrich_geo", _GEO_SQL)
def q_enrich_geo(spark, sf):
    return _geo_flows(spark, sf, "auto")


@query("enrich_geo_distinct", _GEO_SQL)
def q_enrich_geo_distinct(spark, sf):
    return _geo_flows(spark, sf, "distinct")


# A wide table has lengths in whole hex digits: nine of IPv4 and thirty-one of IPv6.
WIDE_SQL = f"""
    WITH f AS (SELECT src_hex AS a, ip_version, src_port, dst_as, bytes FROM v_flows UNION ALL SELECT dst_hex, ip_version, src_port, dst_as, bytes FROM v_flows),
    p AS (SELECT CASE ip_version WHEN 4 THEN 96 + 4 * (bytes % 9) WHEN 6 THEN (CASE bytes % 31 WHEN 30 THEN 128 WHEN 23 THEN 124 ELSE 4 + 4 * (bytes % 31) END) END AS plen,
        a, 'c' || (src_port % 200) AS country, 'p' || (dst_as % 1000) AS city FROM f),
    w AS (SELECT CAST(plen AS INTEGER) AS plen, substr(a, 1, plen // 4) AS lead, max(country || '/' || city) AS place FROM p GROUP BY ALL),
    h AS (SELECT a, place FROM (SELECT x.a, w.place, row_number() OVER (PARTITION BY x.a ORDER BY w.plen DESC) AS r
        FROM (SELECT a, plen, substr(a, 1, plen // 4) AS lead FROM (SELECT DISTINCT a FROM f), (SELECT DISTINCT plen FROM w)) x
        JOIN w ON w.plen = x.plen AND w.lead = x.lead) WHERE r = 1)
    SELECT {_FLOW_KEY}, split_part(s.place, '/', 1) AS src_country, split_part(s.place, '/', 2) AS src_city,
        split_part(d.place, '/', 1) AS dst_country, split_part(d.place, '/', 2) AS dst_city
    FROM v_flows LEFT JOIN h s ON s.a = src_hex LEFT JOIN h d ON d.a = dst_hex"""


def wide_prefixes(flows):
    """A prefix of each end of each flow, of forty lengths in all."""
    ends = [flows.select(F.col(f"{side}_ip").alias("prefix"), "ip_version", "src_port", "dst_as", "bytes") for side in ("src", "dst")]
    ends = ends[0].unionAll(ends[1])
    six = F.expr("CASE bytes % 31 WHEN 30 THEN 128 WHEN 23 THEN 124 ELSE 4 + 4 * (bytes % 31) END")
    plen = F.when(F.col("ip_version") == 4, 96 + 4 * (F.col("bytes") % 9)).otherwise(six)
    return ends.select(
        "prefix", plen.cast("int").alias("plen"), F.concat(F.lit("c"), (F.col("src_port") % 200).cast("string")).alias("country"),
        F.concat(F.lit("p"), (F.col("dst_as") % 1000).cast("string")).alias("city"),
    )


def wide_table(spark, sf):
    def store(df, name):
        path = work_dir(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    return RangeTable.of({"geo": (wide_prefixes(v.flows(spark, sf)), ["country", "city"])}, store)


def wide_lookup(flows, table):
    found = table.lookup_ends(flows, {"src_ip": "_src", "dst_ip": "_dst"})
    return found.withColumns({f"{s}_{c}": F.col(f"_{s}.geo.{c}") for s in ("src", "dst") for c in ("country", "city")}).drop("_src", "_dst")


@query("enrich_wide_table", sql(WIDE_SQL))
def enrich_wide_table(spark, sf):
    out = wide_lookup(v.flows(spark, sf), wide_table(spark, sf))
    return v.printable(
        out.select(
            "ts", "exporter_ip", "in_if", "out_if", "src_ip", "dst_ip", "bytes",
            "src_country", "src_city", "dst_country", "dst_city",
        )
    )


@query("enrich_asn", sql(f"SELECT {_FLOW_KEY}, src_as, src_as_name, dst_as, dst_as_name FROM v_flows_asn"))
def q_enrich_asn(spark, sf):
    out = enrich_asn(v.flows(spark, sf), v.asn(spark, sf))
    return v.printable(
        out.select(
            "ts", "exporter_ip", "in_if", "out_if", "src_ip", "dst_ip", "bytes",
            "src_as", "src_as_name", "dst_as", "dst_as_name",
        )
    )


ENRICHED_COLUMNS = [
    "ts", "exporter_ip", "exporter_name", "exporter_site", "exporter_region", "exporter_role", "in_if", "in_if_name",
    "in_if_speed", "out_if", "out_if_name", "out_if_speed", "src_ip", "dst_ip", "protocol", "src_port", "dst_port",
    "bytes", "packets", "src_as", "dst_as", "src_country", "src_city", "dst_country", "dst_city", "src_as_name",
    "dst_as_name", "direction",
]
ENRICHED_SQL = sql(f"SELECT {', '.join(ENRICHED_COLUMNS)} FROM v_enriched")


@query("enrich_full", ENRICHED_SQL)
def enrich_full(spark, sf):
    return v.printable(enrich(v.flows(spark, sf), v.dimensions(spark, sf)).select(*ENRICHED_COLUMNS))


# ------------------------------------------------------------ rollups

_MEASURES = """CAST(sum(bytes) AS BIGINT) AS bytes_sum, CAST(sum(packets) AS BIGINT) AS packets_sum,
    count(*) AS flow_count"""


def minute_sql(source, named):
    blank = "" if named else "'' AS exporter_site, '' AS exporter_name, '' AS in_if_name, '' AS out_if_name, "
    named_keys = "exporter_site, exporter_name, in_if_name, out_if_name, " if named else ""
    country = "src_country, dst_country" if named else "'' AS src_country, '' AS dst_country"
    return sql(f"""SELECT time_bucket(INTERVAL '1 minute', ts) AS minute, {named_keys}{blank}src_ip, dst_ip, protocol,
        src_port, dst_port, src_as, dst_as, {country}, {_MEASURES} FROM {source} GROUP BY ALL""")


def hour_sql(source, named):
    blank = "" if named else "'' AS exporter_site, '' AS exporter_name, '' AS in_if_name, '' AS out_if_name, "
    named_keys = "exporter_site, exporter_name, in_if_name, out_if_name, " if named else ""
    country = "src_country, dst_country" if named else "'' AS src_country, '' AS dst_country"
    return sql(f"""SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, {named_keys}{blank}src_network, dst_network,
        ip_version, protocol, dst_port, src_as, dst_as, {country}, {_MEASURES} FROM {source} GROUP BY ALL""")


@query("rollup_1m", minute_sql("v_enriched", True))
def rollup_1m(spark, sf):
    return v.printable(rollup.rollup_1m(enrich(v.flows(spark, sf), v.dimensions(spark, sf))))


@query("rollup_1h", hour_sql("v_enriched", True))
def rollup_1h(spark, sf):
    return v.printable(rollup.rollup_1h(enrich(v.flows(spark, sf), v.dimensions(spark, sf))))


@query("rollup_merge", minute_sql("v_event_flows", False))
def rollup_merge(spark, sf):
    """Partials of each hour slice of the day, merged: equals one pass over all rows."""
    flows = v.event_flows(spark, sf)
    morning, rest = F.hour("ts") < 12, F.hour("ts") >= 12
    partials = rollup.rollup_1m(flows.where(morning)).unionByName(rollup.rollup_1m(flows.where(rest)))
    return v.printable(rollup.merge_partials(partials, rollup.MINUTE_KEYS))


@query("rollup_1m_to_1h", hour_sql("v_event_flows", False))
def rollup_1m_to_1h(spark, sf):
    return v.printable(rollup.minute_to_hour(rollup.rollup_1m(v.event_flows(spark, sf))))


@query("traffic_by_hour_of_site", sql("""
    SELECT exporter_site, time_bucket(INTERVAL '1 hour', ts) AS hour, CAST(sum(bytes) AS BIGINT) AS total_bytes
    FROM v_enriched GROUP BY ALL"""))
def traffic_by_hour_of_site(spark, sf):
    """Tier reuse: an hourly question answered from minute partials."""
    flows = enrich_device(v.flows(spark, sf), v.devices(spark, sf))
    hours = rollup.minute_to_hour(rollup.rollup_1m(flows))
    return v.printable(hours.groupBy("exporter_site", "hour").agg(F.sum("bytes_sum").alias("total_bytes")))


# ------------------------------------------------------------ retention


@query("retention_7d", sql("""
    SELECT ts, exporter_ip, bytes FROM v_event_flows WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY"""))
def retention_7d(spark, sf):
    kept = retained(v.event_flows(spark, sf), "ts", "2024-01-31 00:00:00", 7)
    return v.printable(kept.select("ts", "exporter_ip", "bytes"))


@query("retention_tiers", sql(f"""
    SELECT 'raw' AS tier, count(*) AS rows_kept, min(ts) AS oldest FROM v_event_flows
      WHERE ts > TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 7 DAY
    UNION ALL SELECT '1m', count(*), min(minute) FROM (
      SELECT DISTINCT time_bucket(INTERVAL '1 minute', ts) AS minute, src_ip, dst_ip, protocol, dst_port FROM v_event_flows)
      WHERE minute > TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY
    UNION ALL SELECT '1h', count(*), min(hour) FROM (
      SELECT DISTINCT time_bucket(INTERVAL '1 hour', ts) AS hour, src_network, dst_network, protocol, dst_port
      FROM v_event_flows) WHERE hour > TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 90 DAY"""))
def retention_tiers(spark, sf):
    flows, as_of = v.event_flows(spark, sf), "2024-02-10 00:00:00"
    tiers = [
        ("raw", flows, "ts"), ("1m", rollup.rollup_1m(flows), "minute"), ("1h", rollup.rollup_1h(flows), "hour"),
    ]
    result = None
    for name, df, column in tiers:
        part = retained(df, column, as_of, rollup.RETENTION_DAYS[name]).agg(
            F.lit(name).alias("tier"), F.count(F.lit(1)).alias("rows_kept"), ntz(F.min(column)).alias("oldest")
        )
        result = part if result is None else result.unionByName(part)
    return result
