"""Flow rollups: one-minute and one-hour partials that merge by summing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.functions.ip import is_v4, network
from netweir.functions.timing import bucket_start
from netweir.schema import HOUR_KEYS, MINUTE_KEYS, RETENTION_DAYS


def rollup_1m(flows: DataFrame) -> DataFrame:
    """Bytes, packets and flow count per minute and the 13 other minute-tier keys."""
    return (
        flows.withColumn("minute", bucket_start(F.col("ts"), 60))
        .groupBy(*MINUTE_KEYS)
        .agg(
            F.sum("bytes").alias("bytes_sum"),
            F.sum("packets").alias("packets_sum"),
            F.count(F.lit(1)).alias("flow_count"),
        )
    )


def _networks(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("src_network", network(F.col("src_ip")))
        .withColumn("dst_network", network(F.col("dst_ip")))
        .withColumn("ip_version", F.when(is_v4(F.col("src_ip")), 4).otherwise(6))
    )


def rollup_1h(flows: DataFrame) -> DataFrame:
    """The hour tier from raw flows: networks instead of addresses, no source port."""
    return (
        _networks(flows)
        .withColumn("hour", bucket_start(F.col("ts"), 3600))
        .groupBy(*HOUR_KEYS)
        .agg(
            F.sum("bytes").alias("bytes_sum"),
            F.sum("packets").alias("packets_sum"),
            F.count(F.lit(1)).alias("flow_count"),
        )
    )


def merge_partials(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Combine partial rows of the same key; counts are summed, not counted."""
    return partials.groupBy(*keys).agg(
        F.sum("bytes_sum").alias("bytes_sum"),
        F.sum("packets_sum").alias("packets_sum"),
        F.sum("flow_count").alias("flow_count"),
    )


def minute_to_hour(minutes: DataFrame) -> DataFrame:
    """The hour tier from minute partials, without reading raw flows."""
    coarse = _networks(minutes).withColumn("hour", bucket_start(F.col("minute"), 3600))
    return merge_partials(coarse, HOUR_KEYS)


def retained(df: DataFrame, time_column: str, as_of: str, days: int) -> DataFrame:
    """Rows a table with a time-to-live still holds at ``as_of``."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return df.where(F.col(time_column) > limit)


def pick_tier(range_seconds: int, needed_columns: set[str]) -> str:
    """The coarsest tier that still has the columns and covers the asked-for range.

    A panel wants about a thousand points at most: hours beyond a week, minutes beyond
    six hours. A range older than a tier's retention needs the next coarser tier.
    """
    hour_ok = needed_columns <= set(HOUR_KEYS) | {"bytes", "packets", "flows"}
    minute_ok = needed_columns <= set(MINUTE_KEYS) | {"bytes", "packets", "flows"}
    day = 86_400
    if hour_ok and range_seconds > RETENTION_DAYS["raw"] * day:
        return "1h"
    if minute_ok and range_seconds > 6 * 3600:
        return "1m"
    if range_seconds > RETENTION_DAYS["raw"] * day:
        raise ValueError("no tier holds these columns for so long a range")
    return "raw"
