"""Record shapes and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: wire codes and their labels -------------------------------
FLOW_TYPES = {0: "unknown", 1: "netflow_v5", 2: "netflow_v9", 3: "ipfix", 4: "sflow"}
DIRECTIONS = {0: "unknown", 1: "ingress", 2: "egress"}
TCP_FLAG_BITS = {0: "FIN", 1: "SYN", 2: "RST", 3: "PSH", 4: "ACK", 5: "URG", 6: "ECE", 7: "CWR"}

# --- fixed values: label names every target and series may carry -------------
LABEL_TAXONOMY = ["device", "site", "region", "vendor", "platform", "role", "tier"]

# --- fixed values: how long each tier is kept --------------------------------
RETENTION_DAYS = {"raw": 7, "1m": 30, "1h": 90}
METRIC_RETENTION_DAYS = {"raw": 14, "5m": 30, "1h": 90}

# Flow record as it travels (proto3 defaults, never null).
WIRE_FLOW = T.StructType(
    [
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("flow_type", T.IntegerType()),
        T.StructField("exporter_ip", T.LongType()),
        T.StructField("exporter_name", T.StringType()),
        T.StructField("exporter_site", T.StringType()),
        T.StructField("exporter_region", T.StringType()),
        T.StructField("exporter_role", T.StringType()),
        T.StructField("in_if", T.LongType()),
        T.StructField("out_if", T.LongType()),
        T.StructField("in_if_name", T.StringType()),
        T.StructField("out_if_name", T.StringType()),
        T.StructField("in_if_speed", T.LongType()),
        T.StructField("out_if_speed", T.LongType()),
        T.StructField("src_ip", T.BinaryType()),
        T.StructField("dst_ip", T.BinaryType()),
        T.StructField("ip_version", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("packets", T.LongType()),
        T.StructField("sampling_rate", T.LongType()),
        T.StructField("src_as", T.LongType()),
        T.StructField("dst_as", T.LongType()),
        T.StructField("next_hop", T.LongType()),
        T.StructField("src_country", T.StringType()),
        T.StructField("src_city", T.StringType()),
        T.StructField("dst_country", T.StringType()),
        T.StructField("dst_city", T.StringType()),
        T.StructField("src_as_name", T.StringType()),
        T.StructField("dst_as_name", T.StringType()),
        T.StructField("src_vlan", T.IntegerType()),
        T.StructField("dst_vlan", T.IntegerType()),
        T.StructField("direction", T.IntegerType()),
    ]
)

FLOW_COLUMNS = ["ts"] + [f.name for f in WIRE_FLOW if f.name != "timestamp_ms"]

# --- fixed values: what the one-minute and the one-hour tier group by ---------
MINUTE_KEYS = [
    "minute", "exporter_site", "exporter_name", "in_if_name", "out_if_name",
    "src_ip", "dst_ip", "protocol", "src_port", "dst_port",
    "src_as", "dst_as", "src_country", "dst_country",
]
HOUR_KEYS = [
    "hour", "exporter_site", "exporter_name", "in_if_name", "out_if_name",
    "src_network", "dst_network", "ip_version", "protocol", "dst_port",
    "src_as", "dst_as", "src_country", "dst_country",
]

SAMPLE = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)

AUDIT_EVENT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("executionName", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("runbookName", T.StringType()),
        T.StructField("stepName", T.StringType()),
        T.StructField("triggeredBy", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)
