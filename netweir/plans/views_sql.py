"""The mapping of ``views`` in DuckDB SQL, and a helper that prepends what a query uses."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def _v4_text(n: str) -> str:
    return f"format('{{}}.{{}}.{{}}.{{}}', ({n})//16777216, (({n})//65536)%256, (({n})//256)%256, ({n})%256)"


def _v4_net(n: str) -> str:
    return f"format('{{}}.{{}}.{{}}.0', ({n})//16777216, (({n})//65536)%256, (({n})//256)%256)"


def _v6_text(net: str, host: str) -> str:
    return (
        f"'2001:0db8:' || printf('%04x', ({net})%65536) || ':0000:0000:0000:' || "
        f"printf('%04x', ({host})//65536) || ':' || printf('%04x', ({host})%65536)"
    )


def _address(prefix: str, net: str, host: str) -> str:
    n = f"16777216*(1 + {net} % 100) + {host} % 16777216"
    return f"""
      CASE WHEN l_tax > 0.075 THEN {_v6_text(net, host)} ELSE {_v4_text(n)} END AS {prefix}_ip,
      CASE WHEN l_tax > 0.075 THEN '20010DB8' || printf('%04X', {net}%65536) || '000000000000' || printf('%08X', {host})
           ELSE '00000000000000000000FFFF' || printf('%08X', {n}) END AS {prefix}_hex,
      CASE WHEN l_tax > 0.075 THEN '2001:0db8:' || printf('%04x', {net}%65536) || ':0000:0000:0000:0000:0000'
           ELSE {_v4_net(n)} END AS {prefix}_network"""


VIEWS["v_flows"] = f"""
  SELECT l_shipdate + to_seconds(l_orderkey % 86400) AS ts,
      CASE l_linenumber % 5 WHEN 1 THEN 'netflow_v5' WHEN 2 THEN 'netflow_v9' WHEN 3 THEN 'ipfix'
           WHEN 4 THEN 'sflow' ELSE 'unknown' END AS flow_type,
      167772160 + l_suppkey AS exporter_ip,
      CAST(l_linenumber AS BIGINT) AS in_if, 1 + l_partkey % 8 AS out_if,
      {_address('src', 'l_suppkey', 'l_partkey')}, {_address('dst', 'l_partkey', 'l_suppkey')},
      CASE WHEN l_tax > 0.075 THEN 6 ELSE 4 END AS ip_version,
      CASE l_linenumber % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS protocol,
      CAST(1024 + l_partkey % 1000 AS INTEGER) AS src_port,
      CASE l_linenumber WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 53 WHEN 4 THEN 22 WHEN 5 THEN 179
           WHEN 6 THEN 123 ELSE 8080 END AS dst_port,
      CAST(l_quantity AS INTEGER) AS tcp_flags,
      CAST(round(l_extendedprice*100) AS BIGINT) AS bytes,
      CAST(l_quantity AS BIGINT) AS packets,
      CAST(CASE WHEN l_linestatus = 'O' THEN 1000 ELSE 1 END AS BIGINT) AS sampling_rate,
      CAST(CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE 64500 + l_suppkey % 20 END AS BIGINT) AS src_as,
      CAST(CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE 64500 + l_partkey % 20 END AS BIGINT) AS dst_as,
      167772160 + l_partkey % 256 AS next_hop,
      CAST(l_linenumber * 100 AS INTEGER) AS src_vlan, CAST(l_linenumber * 100 + 1 AS INTEGER) AS dst_vlan,
      CASE l_returnflag WHEN 'A' THEN 'ingress' WHEN 'R' THEN 'egress' ELSE 'unknown' END AS direction
  FROM lineitem"""

VIEWS["v_event_flows"] = f"""
  SELECT make_timestamp((epoch_us(ts) // 21600000000 * 21600 + event_id % 30) * 1000000) AS ts, 167772160 + user_id AS exporter_ip,
      1 + event_id % 2 AS in_if, 1 + event_id % 3 AS out_if,
      {_v4_text('16777216*(1 + user_id % 2)')} AS src_ip,
      {_v4_text('16777216*(1 + event_id % 2)')} AS dst_ip,
      {_v4_net('16777216*(1 + user_id % 2)')} AS src_network,
      {_v4_net('16777216*(1 + event_id % 2)')} AS dst_network,
      4 AS ip_version,
      CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 6 ELSE 17 END AS protocol,
      1024 AS src_port, CASE WHEN event_type = 'view' THEN 443 ELSE 53 END AS dst_port,
      CAST(0 AS BIGINT) AS src_as, CAST(0 AS BIGINT) AS dst_as,
      CAST(round(value*100) AS BIGINT) AS bytes, event_id % 7 + 1 AS packets
  FROM events"""

VIEWS["v_supplier"] = """
  SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

VIEWS["v_device"] = """
  SELECT 167772160 + s_suppkey AS mgmt_ip, s_name AS name, n_name AS site, r_name AS region,
      CASE s_suppkey % 3 WHEN 0 THEN 'core-router' WHEN 1 THEN 'edge' ELSE 'spine' END AS role
  FROM v_supplier WHERE s_acctbal >= 0"""

VIEWS["v_interface"] = """
  SELECT 167772160 + s_suppkey AS mgmt_ip, CAST(i AS BIGINT) AS snmp_index, 'Ethernet' || i AS name,
      CAST(1000000 * i AS BIGINT) AS speed
  FROM supplier, generate_series(1, 7) AS g(i)"""


def _v4_row(base: str, length: str, *attributes: str) -> str:
    mapped = "'00000000000000000000FFFF' || "
    return (
        f"SELECT {mapped}printf('%08X', CAST({base} AS BIGINT)) AS lo, "
        f"{mapped}printf('%08X', CAST({base} + (1 << (32 - {length})) - 1 AS BIGINT)) AS hi, "
        f"96 + {length} AS plen, {', '.join(attributes)} FROM nation"
    )


def _v6_row(text: str, digits: int, length: int, where: str, *attributes: str) -> str:
    return (
        f"SELECT {text} || repeat('0', {32 - digits}) AS lo, {text} || repeat('F', {32 - digits}) AS hi, "
        f"{length} AS plen, {', '.join(attributes)} FROM nation WHERE {where}"
    )


def _place(key: str) -> tuple[str, str]:
    return f"'N' || ({key}) AS country", f"'City_' || ({key}) AS city"


_OCTET = "(1 + 4*CAST(n_nationkey AS BIGINT) + {i})*16777216"
VIEWS["v_geo"] = " UNION ALL ".join(
    [_v4_row(_OCTET.format(i=i), "8", *_place("n_nationkey")) for i in range(3)]
    + [
        _v4_row(_OCTET.format(i=0), "16", *_place("(n_nationkey + 1) % 25")),
        _v4_row(_OCTET.format(i=1), "20", *_place("(n_nationkey + 2) % 25")),
        _v6_row("'20010DB8' || printf('%04X', n_nationkey)", 12, 48, "true", *_place("n_nationkey")),
        _v6_row("'20010DB8'", 8, 32, "n_nationkey = 0", *_place("99")),
    ]
)
VIEWS["v_asn"] = " UNION ALL ".join(
    [
        _v4_row(_OCTET.format(i=i), "8", "CAST(65000 + n_nationkey AS BIGINT) AS asn", "'AS-' || n_name AS as_name")
        for i in range(4)
    ]
    + [_v4_row(_OCTET.format(i=3), "20", "CAST(66000 + n_nationkey AS BIGINT) AS asn", "'EDGE-' || n_name AS as_name")]
)
VIEWS["v_site_prefix"] = " UNION ALL ".join(
    _v4_row(_OCTET.format(i=i), "(CASE WHEN n_regionkey = 4 THEN 20 ELSE 8 END)", "n_name AS site") for i in range(4)
)
VIEWS["v_address"] = "SELECT src_hex AS ip FROM v_flows UNION SELECT dst_hex FROM v_flows"
for _name, _fields in (("geo", "country, city"), ("asn", "asn, as_name"), ("site_prefix", "site")):
    VIEWS[f"v_{_name}_hit"] = f"""
  SELECT ip, {_fields} FROM v_address JOIN v_{_name} ON ip >= lo AND ip <= hi
  QUALIFY row_number() OVER (PARTITION BY ip ORDER BY plen DESC) = 1"""

VIEWS["v_flows_geo"] = """
  SELECT f.*, coalesce(s.country, '') AS src_country, coalesce(s.city, '') AS src_city,
      coalesce(d.country, '') AS dst_country, coalesce(d.city, '') AS dst_city
  FROM v_flows f LEFT JOIN v_geo_hit s ON f.src_hex = s.ip LEFT JOIN v_geo_hit d ON f.dst_hex = d.ip"""
VIEWS["v_flows_asn"] = """
  SELECT f.* EXCLUDE (src_as, dst_as),
      CASE WHEN src_as = 0 THEN coalesce(s.asn, 0) ELSE src_as END AS src_as,
      CASE WHEN dst_as = 0 THEN coalesce(d.asn, 0) ELSE dst_as END AS dst_as,
      coalesce(s.as_name, '') AS src_as_name, coalesce(d.as_name, '') AS dst_as_name
  FROM v_flows_geo f LEFT JOIN v_asn_hit s ON f.src_hex = s.ip LEFT JOIN v_asn_hit d ON f.dst_hex = d.ip"""
VIEWS["v_enriched"] = """
  SELECT f.*, coalesce(v.name, '') AS exporter_name, coalesce(v.site, '') AS exporter_site,
      coalesce(v.region, '') AS exporter_region, coalesce(v.role, '') AS exporter_role,
      coalesce(i.name, '') AS in_if_name, coalesce(i.speed, 0) AS in_if_speed,
      coalesce(o.name, '') AS out_if_name, coalesce(o.speed, 0) AS out_if_speed
  FROM v_flows_asn f LEFT JOIN v_device v ON f.exporter_ip = v.mgmt_ip
  LEFT JOIN v_interface i ON v.mgmt_ip = i.mgmt_ip AND f.in_if = i.snmp_index
  LEFT JOIN v_interface o ON v.mgmt_ip = o.mgmt_ip AND f.out_if = o.snmp_index"""


def sql(body: str) -> str:
    """Prepend every view the body names, directly or through another view."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+\b", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    heads = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in needed)
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {heads},\n{text[5:]}"
    return f"WITH {heads}\n{text}"
