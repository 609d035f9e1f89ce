"""Traffic questions over a flows DataFrame. Each is one aggregation, then a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweir.functions.timing import bucket_start, ntz


def _bytes(name: str) -> Column:
    return F.sum("bytes").alias(name)


def _packets(name: str) -> Column:
    return F.sum("packets").alias(name)


def _flow_count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def time_range(flows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with ``start <= ts <= end``.

    Partition pruning works on ``event_date`` only, so where the table has that column
    the same range is stated for it as well.
    """
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    ranged = flows.where((F.col("ts") >= lo) & (F.col("ts") <= hi))
    if "event_date" in flows.columns:
        ranged = ranged.where(
            (F.col("event_date") >= lo.cast("date")) & (F.col("event_date") <= hi.cast("date"))
        )
    return ranged


def top(df: DataFrame, keys: list[str], measure: str, limit: int | None) -> DataFrame:
    """Order by ``measure`` descending with the keys as tie-break, keep ``limit`` rows."""
    ordered = df.orderBy(F.desc(measure), *keys)
    return ordered if limit is None else ordered.limit(limit)


def _ranked(flows, keys, measures, by, limit=None):
    return top(flows.groupBy(*keys).agg(*measures), keys, by, limit)


def top_src_ips(flows: DataFrame, limit: int = 20) -> DataFrame:
    return _ranked(flows, ["src_ip"], [_bytes("total_bytes")], "total_bytes", limit)


def top_dst_ips(flows: DataFrame, limit: int = 20) -> DataFrame:
    return _ranked(flows, ["dst_ip"], [_bytes("total_bytes")], "total_bytes", limit)


def top_conversations(flows: DataFrame, limit: int = 50) -> DataFrame:
    return _ranked(
        flows, ["src_ip", "dst_ip", "protocol"],
        [_bytes("total_bytes"), _packets("total_packets")], "total_bytes", limit,
    )


def top_protocols(flows: DataFrame, limit: int = 10) -> DataFrame:
    return _ranked(flows, ["protocol"], [_bytes("total_bytes")], "total_bytes", limit)


def protocol_bytes(flows: DataFrame) -> DataFrame:
    return _ranked(flows, ["protocol"], [_bytes("total_bytes")], "total_bytes")


def protocol_packets(flows: DataFrame) -> DataFrame:
    return _ranked(flows, ["protocol"], [_packets("total_packets")], "total_packets")


def top_ports(flows: DataFrame, side: str, limit: int = 20) -> DataFrame:
    return _ranked(flows, [f"{side}_port"], [_bytes("total_bytes")], "total_bytes", limit)


def tcp_flag_distribution(flows: DataFrame, limit: int = 16) -> DataFrame:
    return _ranked(
        flows.where(F.col("protocol") == 6), ["tcp_flags"],
        [_flow_count("flow_count"), _bytes("total_bytes")], "flow_count", limit,
    )


def top_asn(flows: DataFrame, side: str, limit: int = 20) -> DataFrame:
    column = f"{side}_as"
    return _ranked(flows.where(F.col(column) > 0), [column], [_bytes("total_bytes")], "total_bytes", limit)


def as_pairs(flows: DataFrame, limit: int = 50) -> DataFrame:
    return _ranked(
        flows.where((F.col("src_as") > 0) & (F.col("dst_as") > 0)), ["src_as", "dst_as"],
        [_bytes("total_bytes"), _packets("total_packets"), _flow_count("flow_count")], "total_bytes", limit,
    )


def as_matrix(flows: DataFrame, limit: int = 50) -> DataFrame:
    return _ranked(
        flows, ["src_as", "dst_as"], [_bytes("total_bytes"), _flow_count("flow_count")], "total_bytes", limit
    )


def site_matrix(flows: DataFrame) -> DataFrame:
    return _ranked(
        flows, ["src_site", "dst_site"], [_bytes("total_bytes"), _flow_count("flow_count")], "total_bytes"
    )


def protocol_per_path(flows: DataFrame, limit: int = 50) -> DataFrame:
    return _ranked(flows, ["src_site", "dst_site", "protocol"], [_bytes("total_bytes")], "total_bytes", limit)


def country_bytes(flows: DataFrame, side: str, limit: int | None = None) -> DataFrame:
    column = f"{side}_country"
    return _ranked(flows.where(F.col(column) != ""), [column], [_bytes("total_bytes")], "total_bytes", limit)


def _series(flows: DataFrame, condition: Column, measure: str, interval_s: int) -> DataFrame:
    bucketed = flows.where(condition).withColumn("time", ntz(bucket_start(F.col("ts"), interval_s)))
    return bucketed.groupBy("time").agg(_bytes(measure)).orderBy("time")


def transit_series(flows: DataFrame, interval_s: int = 60) -> DataFrame:
    """Bytes over time between two different, known autonomous systems."""
    known = (F.col("src_as") > 0) & (F.col("dst_as") > 0)
    return _series(flows, known & (F.col("src_as") != F.col("dst_as")), "transit_bytes", interval_s)


def cross_border_series(flows: DataFrame, interval_s: int = 60) -> DataFrame:
    """Bytes over time between two different, known countries."""
    known = (F.col("src_country") != "") & (F.col("dst_country") != "")
    return _series(
        flows, known & (F.col("src_country") != F.col("dst_country")), "cross_border_bytes", interval_s
    )


def interface_bit_rate(flows: DataFrame, exporters: list[int] | None, interval_s: int = 60) -> DataFrame:
    """Bits per second by exporter, input interface and time bucket."""
    chosen = flows if exporters is None else flows.where(F.col("exporter_ip").isin(exporters))
    return (
        chosen.withColumn("time", ntz(bucket_start(F.col("ts"), interval_s)))
        .groupBy("time", "exporter_ip", "in_if")
        .agg((F.sum("bytes") * 8 / F.lit(interval_s)).alias("bits_per_sec"))
        .orderBy("time", "exporter_ip", "in_if")
    )


def scaled_bytes(flows: DataFrame) -> DataFrame:
    """Bytes corrected for sampling: each sampled flow stands for ``sampling_rate`` flows."""
    rate = F.when(F.col("sampling_rate") > 0, F.col("sampling_rate")).otherwise(F.lit(1))
    return flows.withColumn("bytes", F.col("bytes") * rate)
