"""Flow streams: enrichment, raw table, rollup partials, duplicate removal."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweir.operators.enrich import Dimensions, enrich
from netweir.operators.rollup import RETENTION_DAYS, merge_partials, rollup_1h, rollup_1m
from netweir.schema import HOUR_KEYS, MINUTE_KEYS
from netweir.sources import store

log = logging.getLogger(__name__)


def run_available(writer, checkpoint: str):
    """Process everything that has arrived, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_raw_table(flows: DataFrame, path: str, files_per_day: int | None = None):
    """Writer of a flow stream into the day-partitioned raw table.

    A batch is usually of one day, so its rows are dealt by exporter and time over all tasks
    of a shuffle, unless ``files_per_day`` asks for fewer and larger files.
    """
    files = files_per_day or int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64("exporter_ip", "ts"), F.lit(files))
    dated = flows.withColumn("event_date", F.to_date("ts")).repartition("event_date", spread)
    return dated.writeStream.format("parquet").option("path", path).partitionBy("event_date").outputMode("append")


# ------------------------------------------------------------ rollup partials


def _append_batch(rows: DataFrame, path: str, period: str, batch_id: int) -> None:
    """Write a batch below its days (or months). A retry replaces the folders of the batch."""
    (
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(period, "batch_id").parquet(path)
    )


#: Keys, time column and period of the tiers that a stream keeps in a store.
TIERS = {"1m": (MINUTE_KEYS, "minute", "event_date"), "1h": (HOUR_KEYS, "hour", "event_month")}


def write_partials(path: str, raw: bool = True) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: raw rows and both tiers in one pass over the batch.

    A tier is a store (``sources.store``) whose parts hold a batch each, below its days (the hour
    tier: months). A restart, also one after a compaction, never counts a flow twice. A late flow
    just adds a partial to its old minute.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if raw:
                _append_batch(batch.withColumn("event_date", F.to_date("ts")), f"{path}/raw", "event_date", batch_id)
            for tier, rolled in (("1m", rollup_1m), ("1h", rollup_1h)):
                _, time_column, period = TIERS[tier]
                store.append(rolled(batch), f"{path}/{tier}", time_column, period, batch_id)
        finally:
            batch.unpersist()

    return sink


def read_tier(spark: SparkSession, path: str, tier: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A tier as readers see it: partials of all batches merged, of ``[start, end)`` if given."""
    return merge_partials(store.read(spark, f"{path}/{tier}", start, end), TIERS[tier][0])


def compact_tier(spark: SparkSession, path: str, tier: str, fan: int = store.FAN) -> int:
    """Merge the batches of a tier; its stream may go on meanwhile."""
    keys = TIERS[tier][0]
    return store.compact(spark, f"{path}/{tier}", lambda rows, period: merge_partials(rows, [*keys, period]), [keys[1], keys[0]], fan)


def expire_tier(spark: SparkSession, path: str, tier: str, as_of: str, days: int | None = None) -> str:
    """Apply the tier's time-to-live (or ``days``) and return the limit."""
    return store.expire(spark, f"{path}/{tier}", as_of, RETENTION_DAYS[tier] if days is None else days)


def rollup_1m_closed(flows: DataFrame, delay: str) -> DataFrame:
    """The minute tier in append mode: a minute comes out once the watermark has passed it.

    Flows later than ``delay`` are dropped; use the partials where none may be lost.
    """
    keys = [k for k in MINUTE_KEYS if k != "minute"]
    grouped = flows.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute").alias("w"), *keys)
    totals = grouped.agg(
        F.sum("bytes").alias("bytes_sum"), F.sum("packets").alias("packets_sum"), F.count(F.lit(1)).alias("flow_count")
    )
    return totals.select(F.col("w.start").alias("minute"), *keys, "bytes_sum", "packets_sum", "flow_count")


def drop_redelivered(stream: DataFrame, keys: list[str], time_column: str, delay: str) -> DataFrame:
    """Remove records that a producer or a broker delivered again within ``delay``."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(keys)


# ------------------------------------------------------------ enrichment with refresh


class RefreshingDimensions:
    """Lookup tables that are loaded again once they are older than ``refresh_s``.

    A load is written to ``path`` first; if it fails, the last good copy stays in use.
    """

    def __init__(self, spark: SparkSession, loader: Callable[[], Dimensions], path: str, refresh_s: float = 300.0):
        self.spark, self.loader, self.path, self.refresh_s = spark, loader, path, refresh_s
        self.current: Dimensions | None = None
        self.loaded_at = 0.0
        self.version = 0

    def _copy(self, df: DataFrame, name: str) -> DataFrame:
        folder = f"{self.path}/v{self.version}/{name}"
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder)

    def _load(self) -> Dimensions:
        fresh = self.loader()
        self.version += 1
        tables = {}
        for name in ("device", "interface"):
            df = getattr(fresh, name)
            tables[name] = None if df is None else self._copy(df, name)
        for name in ("geo", "asn"):
            table = getattr(fresh, name)
            tables[name] = None if table is None else replace(table, rows=self._copy(table.rows, name))
        for old in range(1, self.version - 1):  # the copy before this one may still be read
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return Dimensions(**tables)

    def get(self) -> Dimensions:
        if self.current is None or time.monotonic() - self.loaded_at >= self.refresh_s:
            try:
                self.current = self._load()
            except Exception:
                if self.current is None:
                    raise
                log.exception("lookup refresh failed, keeping the last good copy")
            self.loaded_at = time.monotonic()
        return self.current


def enrich_batches(dimensions: RefreshingDimensions, path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: enrich with the current lookup tables and write the batch's folder."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        enrich(batch, dimensions.get()).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return sink


def ranged_batches(table, look, path: str, decode=lambda wire: wire) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: ``look(batch, table)`` with a ``RangeTable`` of any size, written to the
    batch's folder. A packed table is searched in place; a larger one is merged with the batch.

    ``decode`` makes flows of wire rows here, where the optimizer sees which of their columns are
    constants: those do not move with the flows that are merged."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        look(decode(batch), table).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return sink
