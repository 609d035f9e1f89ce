"""Session settings and the shared work folder every job uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the operators rely on. They can be set on a live session, so a
# session made by someone else (a notebook, a cluster job) is brought into line too.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # HotSpot does not compile methods beyond 8000 bytes of bytecode; Spark's own limit is
    # higher, and a stage between the two limits would run interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    # The stock 200 shuffle partitions suit neither a laptop nor a large cluster. On one
    # machine two per core are enough; a cluster states its own number.
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(max(8, spark.sparkContext.defaultParallelism)))
    return spark


# Rows of series and flows take many times their compressed shuffle bytes in a task's memory, so
# shuffles are cut finely; adaptive execution puts small pieces together again.
FINE_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def fine_partitions(spark: SparkSession) -> SparkSession:
    """Let the memory of a task follow the size of a shuffle piece, not that of the input."""
    for key, value in FINE_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("netweir")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Do not record a Python stack for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for checkpoints and written tables, shared by all executors.

    The cluster names the parent in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder, because nothing else shares a machine's disk.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not parent:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="netweir-"))
        parent = spark.sparkContext.getCheckpointDir()
    return f"{parent.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
