"""Embedding near-duplicates by an epsilon grid order join.

Vectors of length one are projected on their leading principal axes and sorted by grid cells of
side epsilon, where epsilon is the distance at which the cosine falls to the limit. The sequence
is cut into intervals. Two intervals whose boxes are farther apart than epsilon never meet; of two
that may meet, blocks are compared whose boxes are near. The length of what the axes leave of a
vector is one more axis, and in these axes alone no two vectors are farther apart than in all:
a product of the short vectors leaves few pairs, whose cosine is then taken in double precision.

Intervals that meet are read by the task that compares them (a Cartesian product), so nothing is
shuffled or written per pair and disk grows with the vectors. Exact copies are one point with a
weight.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from netweir.llm.common import components, partitions, small_batches, stored
from netweir.session import work_dir

AXES = 32  # of the short vectors and boxes
CELLS = 8  # leading axes that order the sequence
INTERVAL = 4096  # vectors in an interval of the sequence: what one side of a comparison holds
BLOCK = 256
ROW_GROUP = 16 << 20  # bytes of intervals that a reader holds at once
SLACK = 1e-7  # on distances of boxes, so that rounding skips nothing


def unit_vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By dimension, of the vectors that can link: their rows in ``column``, their numbers as
    given, and their vectors of length one in double precision."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    missing = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
    out = []
    for dim in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == dim)
        places = starts[at][:, None] + np.arange(dim)
        given = values[places]
        v = given.astype(np.float64)
        scale = np.abs(v).max(axis=1)
        fine = np.isfinite(scale) & (scale > 0)
        if missing is not None:
            fine &= ~missing[places].any(axis=1)
        v = v[fine] / scale[fine][:, None]
        out.append((at[fine], given[fine], v / np.sqrt((v * v).sum(axis=1))[:, None]))
    return out


def _units(raws: list[bytes], dim: int, kind: str) -> np.ndarray:
    """Vectors of length one from their numbers as given."""
    given = np.frombuffer(b"".join(raws), kind).reshape(-1, dim)
    v = given.astype(np.float64)
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _points(rows: DataFrame, kind: str, with_raw: bool) -> DataFrame:
    """vec_id, dim, key (names the vector) of every row, the last two null where it links with
    nothing; ``with_raw`` adds its numbers as given, of the others only."""
    schema = "vec_id long, dim int, key binary" + (", raw binary" if with_raw else "")

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            present = ids.is_valid().to_numpy(zero_copy_only=False)
            dims, keys, raws = ([None] * batch.num_rows for _ in range(3))
            for at, given, unit in unit_vectors(batch.column("embedding")):
                given = np.ascontiguousarray(given, kind)
                for i, row, u in zip(at.tolist(), given, unit):
                    if present[i]:
                        dims[i], keys[i] = len(u), hashlib.blake2b(u.astype("<f8").tobytes(), digest_size=16).digest()
                        if with_raw:
                            raws[i] = row.tobytes()
            columns = [ids, pa.array(dims, pa.int32()), pa.array(keys, pa.binary())]
            if with_raw:
                columns.append(pa.array(raws, pa.binary()))
            made = pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "key", "raw"][: len(columns)])
            yield made.filter(made.column("dim").is_valid()) if with_raw else made

    return rows.mapInArrow(run, schema)


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """By dimension of the vectors: the leading axes of all of them (AXES columns at most).

    Sums of products are added up per task, then in at most 64 groups for each dimension.
    """

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, _, x in unit_vectors(batch.column("embedding")):
                if len(x):
                    sums[x.shape[1]] = sums.get(x.shape[1], 0) + x.T @ x
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([slot] * len(sums), pa.int32()), pa.array([s.astype("<f8").tobytes() for s in sums.values()], pa.binary())],
            ["dim", "slot", "sums"],
        )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s, "<f8") for s in pdf["sums"])
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "sums": [total.tobytes()]})

    parts = rows.select("embedding").mapInArrow(partial, "dim int, slot int, sums binary").groupBy("dim", "slot").applyInPandas(add, "dim int, sums binary")
    total: dict[int, np.ndarray] = {}
    for r in parts.collect():
        total[r["dim"]] = total.get(r["dim"], 0) + np.frombuffer(r["sums"], "<f8").reshape(r["dim"], r["dim"])
    return {dim: np.linalg.eigh(m)[1][:, ::-1][:, :AXES].copy() for dim, m in total.items()}


def _short(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Places on the axes, and the length of the rest of each vector."""
    at = units @ axes
    return np.column_stack([at, np.sqrt(np.maximum(1 - (at * at).sum(axis=1), 0))])


class _Links:
    """Links found in one comparison: their number per vector and which vectors they join."""

    def __init__(self, n: int):
        self.count, self.root = np.zeros(n, np.int64), np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def add(self, i: np.ndarray, j: np.ndarray, near: np.ndarray, weights: np.ndarray) -> None:
        """near: which of the vectors i link with which of the vectors j, each pair once."""
        self.count[i] += near @ weights[j]
        self.count[j] += weights[i] @ near
        rows, columns = near.any(axis=1), near.any(axis=0)
        i, j, near = i[rows], j[columns], near[np.ix_(rows, columns)]
        # The least row reachable within this block, then one join for each row and column.
        left, big = np.arange(len(i)), len(i)
        while True:
            right = np.where(near, left[:, None], big).min(axis=0)
            new = np.where(near, right[None, :], big).min(axis=1)
            if (new == left).all():
                break
            left = new
        for k, target in [*zip(i.tolist(), i[left].tolist()), *zip(j.tolist(), i[right].tolist())]:
            x, y = self.find(k), self.find(target)
            if x != y:
                self.root[max(x, y)] = min(x, y)


class _Side:
    """An interval as it is compared: units, short vectors and the boxes of its blocks."""

    def __init__(self, row: dict, axes: dict[int, np.ndarray], kind: str):
        self.ids, self.weights = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["weights"], "<i8")
        self.units = _units([row["raws"]], row["dim"], kind)
        short = _short(self.units, axes[row["dim"]])
        self.short, firsts = short.astype(np.float32), np.arange(0, len(short), BLOCK)
        self.lo, self.hi = np.minimum.reduceat(short, firsts), np.maximum.reduceat(short, firsts)


def _join(a: _Side, b: _Side | None, limit: float, eps: float) -> tuple[np.ndarray, _Links]:
    """Links between the vectors of two intervals, or within ``a``."""
    other, shift = (a, 0) if b is None else (b, len(a.ids))
    ids, weights = (a.ids, a.weights) if b is None else (np.concatenate([a.ids, b.ids]), np.concatenate([a.weights, b.weights]))
    links = _Links(len(ids))
    # Above the error of the product of short vectors in single precision.
    least = np.float32(limit - 1e-5 - 2.4e-7 * a.short.shape[1])
    for k in range(len(a.lo)):
        gap = np.maximum(np.maximum(other.lo - a.hi[k], a.lo[k] - other.hi), 0)
        meets = (gap * gap).sum(axis=1) <= eps * eps + SLACK
        if b is None:
            meets[:k] = False
        if not meets.any():
            continue
        i, j = np.arange(k * BLOCK, min((k + 1) * BLOCK, len(a.ids))), None
        if not meets.all():
            j = np.flatnonzero(np.repeat(meets, BLOCK)[: len(other.ids)])
        product = a.short[i[0] : i[-1] + 1] @ (other.short if j is None else other.short[j]).T
        maybe = product >= least
        columns = np.flatnonzero(maybe.any(axis=0))
        if b is None:
            columns = columns[(columns if j is None else j[columns]) > i[0]]
        if not len(columns):
            continue
        i, j = i[maybe[:, columns].any(axis=1)], columns if j is None else j[columns]
        if not len(i):
            continue
        near = a.units[i] @ other.units[j].T >= limit
        if b is None:
            near &= i[:, None] < j[None, :]
        if near.any():
            links.add(i, j + shift, near, weights)
    return ids, links


def _compared(axes: dict[int, np.ndarray], kind: str, limit: float, eps: float):
    """From rows of two intervals (or one twice) to id, n, root of the vectors with a link."""

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            for row in range(batch.num_rows):
                left, right = ({c: batch.column(f"{s}_{c}")[row].as_py() for c in ("interval", "dim")} for s in ("a", "b"))
                if last[0] != left["interval"]:
                    last = left["interval"], _Side(left | {c: batch.column(f"a_{c}")[row].as_py() for c in ("ids", "weights", "raws")}, axes, kind)
                second = None
                if right["interval"] != left["interval"]:
                    second = _Side(right | {c: batch.column(f"b_{c}")[row].as_py() for c in ("ids", "weights", "raws")}, axes, kind)
                ids, links = _join(last[1], second, limit, eps)
                hit = np.flatnonzero(links.count)
                if len(hit):
                    columns = (ids[hit], links.count[hit], np.array([ids[links.find(i)] for i in hit]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "n", "root"])

    return run


def interval_pairs(intervals: DataFrame, eps: float) -> DataFrame:
    """Every two intervals whose boxes may meet, once, each also with itself, side by side.

    A Cartesian product: its tasks read their intervals from the stored table. Which of two
    intervals comes first changes from pair to pair, so that all tasks have as much to do.
    """
    a, b = (intervals.select(*[F.col(c).alias(f"{s}_{c}") for c in intervals.columns]) for s in ("a", "b"))
    gap = F.expr("aggregate(zip_with(arrays_zip(a_lo, a_hi), arrays_zip(b_lo, b_hi), (a, b) -> greatest(b.b_lo - a.a_hi, a.a_lo - b.b_hi, 0.0D)), 0.0D, (s, g) -> s + g * g)")
    even = F.xxhash64("a_interval").bitwiseXOR(F.xxhash64("b_interval")) % 2 == 0
    once = F.when(F.col("a_interval") == F.col("b_interval"), True).otherwise((F.col("a_interval") < F.col("b_interval")) == even)
    # Written as an order, because a shuffle on the dimension would bring all to one task.
    same_dim = (F.col("a_dim") <= F.col("b_dim")) & (F.col("a_dim") >= F.col("b_dim"))
    return a.join(b.hint("shuffle_replicate_nl"), same_dim & once & (gap <= eps * eps + SLACK))


def near_vectors(rows: DataFrame, limit: float = 0.95) -> DataFrame:
    """Vectors linked by a cosine of at least ``limit``.

    rows: vec_id, embedding (array of numbers) and any other columns. Returns a row per row:
    vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable),
    kept. Null, empty and zero vectors, vectors with null or non-finite components and rows
    without vec_id link with nothing (component null if the id is, and kept). Vectors of
    different dimension never link. Copies are links like any; a repeated row is one more vector
    under the same id, and the id gets the links of all its rows' vector. An empty table gives no rows.
    """
    spark = small_batches(rows.sparkSession)
    single = isinstance(rows.schema["embedding"].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    points = stored(_points(rows, kind, False), "points")
    axes = principal_axes(rows)
    eps = float(np.sqrt(2 - 2 * limit))
    # The vector of a class moves with it once; of copies a task passes on one.
    reps = _points(rows, kind, True).groupBy("dim", "key").agg(F.min(F.struct("vec_id", "raw")).alias("least"), F.count("*").alias("weight"))

    def project(batches):
        for batch in batches:
            dims, raws = batch.column("dim").to_numpy(), batch.column("raw").to_pylist()
            cells = np.empty(len(dims), object)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                found = np.floor(_units([raws[i] for i in at], int(dim), kind) @ axes[int(dim)][:, :CELLS] / eps).astype(np.int32)
                for i, c in zip(at.tolist(), found):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "dim", "weight", "raw")), pa.array(cells.tolist(), pa.list_(pa.int32()))], ["id", "dim", "weight", "raw", "cells"]
            )

    placed = reps.select(F.col("least.vec_id").alias("id"), "dim", "weight", F.col("least.raw").alias("raw")).mapInArrow(
        project, "id long, dim int, weight long, raw binary, cells array<int>"
    )
    ordered = placed.repartitionByRange(max(2, partitions(spark)), "dim", "cells", "id").sortWithinPartitions("dim", "cells", "id")
    path = work_dir(spark, "intervals")
    ordered.mapInArrow(_intervals(axes, kind), INTERVALS).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    intervals = spark.read.schema(INTERVALS).parquet(path)
    pairs = interval_pairs(intervals, eps).drop("a_lo", "a_hi", "b_lo", "b_hi")
    found = stored(pairs.mapInArrow(_compared(axes, kind, limit, eps), "id long, n long, root long"), "found")
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    linking = points.filter("dim IS NOT NULL")
    classes = linking.groupBy("dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    known = classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("dim", "key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    by_id = linking.join(known, ["dim", "key"]).groupBy("vec_id").agg(F.max("n").alias("n"), F.min("component").alias("component"))
    out = points.select("vec_id").join(by_id, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )


INTERVALS = "interval long, dim int, lo array<double>, hi array<double>, ids binary, weights binary, raws binary"


def _intervals(axes: dict[int, np.ndarray], kind: str):
    """Runs of at most INTERVAL vectors of the sorted sequence, as one row with their box."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def close():
            nonlocal made, held
            ids, dims, weights, raws = zip(*held)
            p = _short(_units(raws, dims[0], kind), axes[dims[0]])
            row = [(part << 32) + made, dims[0], p.min(0).tolist(), p.max(0).tolist(), np.array(ids, "<i8").tobytes(), np.array(weights, "<i8").tobytes(), b"".join(raws)]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
            made, held = made + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["interval", "dim", "lo", "hi", "ids", "weights", "raws"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "dim", "weight", "raw"))):
                if held and (len(held) == INTERVAL or held[-1][1] != row[1]):
                    yield close()
                held.append(row)
        if held:
            yield close()

    return run
