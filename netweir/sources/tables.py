"""Tables on shared storage: layout, staged replacement, retention, compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweir.operators.rollup import merge_partials

ROWS_PER_FILE = 20_000_000


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input that comes in fewer pieces than there are cores.

    A single small file is one task. An input with many splits, as on a cluster, is left
    alone, so large data is not shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_raw_flows(flows: DataFrame, path: str, files: int | None = None, mode: str = "append") -> None:
    """Day-partitioned table whose files are clustered by site, exporter and time.

    Ranges are cut by sampling, so a day or a site that holds a large share of the rows
    is spread over several files instead of one task.
    """
    dated = flows.withColumn("event_date", F.to_date("ts"))
    order = ["event_date", "exporter_site", "exporter_name", "ts", "src_ip", "dst_ip"]
    ranged = dated.repartitionByRange(files, *order) if files else dated.repartitionByRange(*order)
    (
        ranged.sortWithinPartitions(*order)
        .write.mode(mode)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("event_date")
        .parquet(path)
    )


def write_hour_tier(hours: DataFrame, path: str, mode: str = "append") -> None:
    """The hour tier, partitioned by month."""
    monthly = hours.withColumn("event_month", F.date_format("hour", "yyyyMM"))
    order = ["event_month", "exporter_site", "exporter_name", "hour"]
    monthly.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("event_month").parquet(path)


def write_minute_tier(minutes: DataFrame, path: str, mode: str = "append") -> None:
    daily = minutes.withColumn("event_date", F.to_date("minute"))
    order = ["event_date", "exporter_site", "exporter_name", "minute"]
    daily.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("event_date").parquet(path)


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Metric samples partitioned by day and metric, series by series inside a file."""
    dated = samples.withColumn("event_date", F.to_date("ts"))
    order = ["event_date", "metric", "series_key", "ts"]
    (
        dated.repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("event_date", "metric").parquet(path)
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("event_date")


def read_prefixes(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Prefix dimension exported as CSV or Parquet; None where there is none.

    A CSV row is ``network`` (16-byte hex), ``plen`` and the attributes of ``schema``.
    """
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return None
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, schema=f"network STRING, plen INT, {schema}")
        return rows.withColumn("prefix", F.unhex("network")).drop("network")
    return spark.read.parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    from netweir.schema import AUDIT_EVENT

    return spark.read.schema(AUDIT_EVENT).json(path)


# ------------------------------------------------------------ replacement


def guarded_overwrite(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> bool:
    """Replace a table unless the new content is empty; returns whether it did.

    The new content is written beside the table first, so a failure on the way leaves
    the old content in place; the replaced content stays beside it until the next time.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex[:8]}"
    writer = df.write.format(fmt).mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(staged)
    fs, staged_path = _fs(spark, staged)
    if spark.read.schema(df.schema).format(fmt).load(staged).isEmpty():
        fs.delete(staged_path, True)
        return False
    _, target = _fs(spark, path)
    _, previous = _fs(spark, f"{path.rstrip('/')}.previous")
    replaced = fs.exists(target)
    if replaced:
        fs.delete(previous, True)
        if not fs.rename(target, previous):
            raise OSError(f"{path} could not be moved aside; its content is as it was, the new one is in {staged}")
    if not fs.rename(staged_path, target):
        if replaced and not fs.rename(previous, target):
            raise OSError(f"{path} could not be replaced; its content is in {previous}, the new one in {staged}")
        raise OSError(f"{path} could not be replaced; its content is as it was, the new one is in {staged}")
    return True


def write_targets(targets: DataFrame, path: str) -> bool:
    """Target lists as JSON lines, one folder per probe; never replaced by nothing."""
    return guarded_overwrite(targets.select("probe", "targets", "labels"), path, "json", ["probe"])


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace just the partitions ``df`` has rows for; the new rows are staged first
    because they usually come from the partitions they replace."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex[:8]}"
    df.write.mode("overwrite").parquet(staged)
    (
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by).parquet(path)
    )
    fs, staged_path = _fs(spark, staged)
    fs.delete(staged_path, True)


def _period_of(period: str, moment) -> Column:
    """The name of the day's (or month's) folder that ``moment`` falls into."""
    return F.date_format(moment, {"event_date": "yyyy-MM-dd", "event_month": "yyyyMM"}[period])


def expire(spark: SparkSession, path: str, time_column: str, as_of: str, days: int, period: str = "event_date") -> list[str]:
    """Apply a time-to-live to a table partitioned by day (or month); returns the dropped periods.

    Periods that ended before the limit are dropped as folders without reading them; the one
    that the limit falls into is rewritten. A period may hold folders of stream batches; one that
    has nothing left goes as well.
    """
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    table = spark.read.parquet(path)
    parts = [period, "batch_id"] if "batch_id" in table.columns else [period]
    name = F.col(period).cast("string")
    # One row per period of the table: bounded by its age.
    listed = table.select(name.alias("name")).distinct().withColumn("old", F.col("name") < _period_of(period, limit))
    dropped = sorted(r["name"] for r in listed.where("old").collect())
    boundary = table.where(name == _period_of(period, limit))
    alive = F.col(time_column) > limit
    # One row per batch of the boundary period.
    left = boundary.groupBy(*parts).agg(F.count(F.when(alive, 1)).alias("alive"), F.count(F.lit(1)).alias("rows")).collect()
    gone = [r for r in left if not r["alive"]]
    if any(0 < r["alive"] < r["rows"] for r in left):
        overwrite_partitions(boundary.where(alive), path, parts)
    folders = [f"{period}={name}" for name in dropped]
    if left and len(gone) == len(left):
        dropped.append(str(left[0][period]))
        folders.append(f"{period}={left[0][period]}")
    elif len(parts) == 2:
        folders += [f"{period}={r[period]}/batch_id={r['batch_id']}" for r in gone]
    for folder in folders:
        fs, jpath = _fs(spark, f"{path.rstrip('/')}/{folder}")
        fs.delete(jpath, True)
    return dropped


def compact_rollup(spark: SparkSession, path: str, keys: list[str], periods: list[str] | None = None, period: str = "event_date") -> None:
    """Merge the partial rows and the small files of a rollup that is partitioned by day (or month).

    A rollup that a stream writes is a store and is compacted by ``sources.store``.
    """
    table = spark.read.parquet(path)
    if periods is not None:
        table = table.where(F.col(period).cast("string").isin(periods))
    order = [period, keys[1], keys[0]]
    merged = merge_partials(table, [*keys, period])
    overwrite_partitions(merged.repartitionByRange(*order).sortWithinPartitions(*order), path, [period])
