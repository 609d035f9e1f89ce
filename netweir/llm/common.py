"""Helpers that several operators share: tables, stored steps, word hashes, connected components."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweir.session import work_dir

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: later steps neither repeat the
    work nor depend on the executors that did it."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of ``stored`` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it. A cluster whose
    executors lack that folder gets the package as any other (--py-files or installed)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def small_batches(spark: SparkSession, most: str = "4m") -> SparkSession:
    """Send Python workers few bytes at once: a worker keeps the memory of its largest batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns, *wanted: str) -> list[str]:
    """Names for working columns that clash with none of ``columns``."""
    taken, names = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)
    return names


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


#: One random number per byte, A-Z folded onto a-z, and one odd multiplier per place in a word.
BYTE_CODES = random_words(256, 11)
BYTE_CODES[65:91] = BYTE_CODES[97:123]
IS_BLANK = np.zeros(256, bool)
IS_BLANK[list(BLANKS)] = True
STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the blank-separated words of UTF-8 bytes, A-Z lower-cased, in order."""
    if not len(data):
        return np.empty(0, np.uint64)
    solid = ~IS_BLANK[data]
    edges = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    kept = data[solid]
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = (np.arange(len(kept)) - np.repeat(first, sizes)).astype(np.uint64)
    codes = mix(BYTE_CODES[kept] + (place + np.uint64(1)) * STEP)
    return mix(np.add.reduceat(codes, first) + sizes.astype(np.uint64))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; a shorter text is one run."""
    if not text:
        return np.empty(0, np.uint64)
    h = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    if not len(h):
        return h
    n = min(words, len(h))
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i] + np.uint64(i + 1))
    return np.unique(acc)


def in_batches(column_names: list[str], make, schema: pa.Schema):
    """A ``mapInArrow`` function: ``make(*columns as python lists)`` returns columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = make(*(batch.column(c).to_pylist() for c in column_names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema
                )

    return run


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One large-star (or small-star) step on distinct pairs (u, v), u <> v."""
    if small:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if small:
        moved = moved.select("v", "m").unionAll(least.select(F.col("u").alias("v"), "m"))
    else:
        moved = moved.filter("v > u").select("v", "m")
    return moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Whether the pairs (u, v) are stars already: no u has two of them, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(
        edges.select(F.col("v"), F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.filter("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that ``edges`` (a, b) join to another: the smallest id reachable.

    Alternating large-star and small-star steps until only stars are left. The minimum of a node
    is a map-side aggregation and the join against it has one row per node on the other side, so
    a hub is split as any skewed join is. Each round is written to the shared folder, which cuts
    the lineage. Self links and links with a null are ignored.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(pairs, "links")
    while not _is_settled(now):
        now, old = stored(_star(_star(now, False), True), "links"), now
        discard(old)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v"), F.col("v")).distinct())
