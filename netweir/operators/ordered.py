"""Row-to-neighbour operators that do not put a whole key into one task.

A plain ``lag`` needs all rows of a key in one place. Here the rows of a key are cut
into chunks of the ordering value. Neighbours inside a chunk come from a window over
(key, chunk); only the first and the last row of each chunk meet in a second window
that links the chunks. Every operator reads its input once, so chains of them stay
linear in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions.timing import floor_div


def _pack(columns: dict[str, str]) -> Column:
    return F.struct(*[F.col(source).alias(out) for source, out in columns.items()])


def with_neighbors(
    df: DataFrame,
    keys: list[str],
    order: str,
    chunk: int,
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
    ties: list[str] | None = None,
) -> DataFrame:
    """Add values of the previous (``before``) and next (``after``) row of the same key.

    ``order`` is a BIGINT column, ``chunk`` the number of its units per chunk; the dicts
    map source column to output column. NULL where there is no neighbour.
    """
    before, after = before or {}, after or {}
    ordering = [order, *(ties or [])]
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*ordering)
    rows = (
        df.withColumn("_chunk", floor_div(F.col(order), chunk))
        .withColumn("_edge", F.lag(F.lit(1)).over(inside).isNull() | F.lead(F.lit(1)).over(inside).isNull())
    )
    # Edge rows of all chunks of a key share one group, all other rows keep their chunk.
    linked = Window.partitionBy(*keys, F.when(~F.col("_edge"), F.col("_chunk"))).orderBy(*ordering)
    outs: list[tuple[str, Column]] = []
    for step, columns in ((F.lag, before), (F.lead, after)):
        if columns:
            tag = step.__name__
            rows = rows.withColumn(f"_own_{tag}", _pack(columns)).withColumn(
                f"_near_{tag}", step(f"_own_{tag}").over(inside)
            )
    for step, columns in ((F.lag, before), (F.lead, after)):
        if columns:
            tag = step.__name__
            rows = rows.withColumn(f"_far_{tag}", step(f"_own_{tag}").over(linked))
            found = F.when(F.col(f"_near_{tag}").isNotNull(), F.col(f"_near_{tag}")).when(
                F.col("_edge"), F.col(f"_far_{tag}")
            )
            outs += [(out, found.getField(out)) for out in columns.values()]
    return rows.select(*df.columns, *[value.alias(out) for out, value in outs])


def carry(df: DataFrame, keys: list[str], order: str, column: str, out: str, chunk: int, back: bool = False) -> DataFrame:
    """Add the latest non-NULL ``column`` at or before each row (at or after, with ``back``)."""
    way = F.col(order).desc() if back else F.col(order).asc()
    inside = Window.partitionBy(*keys, "_chunk").orderBy(way)
    sofar = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        df.withColumn("_chunk", floor_div(F.col(order), chunk))
        .withColumn("_seen", F.last(column, ignorenulls=True).over(sofar))
        .withColumn("_edge", F.lag(F.lit(1)).over(inside).isNull() | F.lead(F.lit(1)).over(inside).isNull())
    )
    linked = Window.partitionBy(*keys, F.when(~F.col("_edge"), F.col("_chunk"))).orderBy(way)
    reached = F.last("_seen", ignorenulls=True).over(linked.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_reached", F.when(F.col("_edge"), reached))
    value = F.coalesce("_seen", F.first("_reached").over(sofar))
    return rows.withColumn(out, value).select(*df.columns, out)


def overlapping_chunks(df: DataFrame, order: str, reach: int, chunk: int) -> DataFrame:
    """Copy each row into the chunk it lies in and those it can still influence.

    A row at ``x`` matters to positions ``x .. x + reach``. With ``chunk >= reach`` that
    is at most two chunks, so windows over (key, ``_chunk``) see every row they need
    and no group grows with the length of the history.
    """
    if chunk < reach:
        raise ValueError("a chunk has to be at least as long as the reach")
    first = floor_div(F.col(order), chunk)
    last = floor_div(F.col(order) + F.lit(reach), chunk)
    return df.withColumn("_chunk", F.explode(F.sequence(first, last)))


def run_pieces(df: DataFrame, keys: list[str], order: str, chunk: int, *more: Column) -> DataFrame:
    """Stretches of consecutive integers, cut at the borders of chunks: ``keys, _chunk, first,
    last`` and ``more`` aggregates of their rows. ``df`` has each (key, ``order``) once."""
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    rows = df.withColumn("_chunk", floor_div(F.col(order), chunk)).withColumn("_island", F.col(order) - F.row_number().over(inside))
    pieces = rows.groupBy(*keys, "_chunk", "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), *more)
    return pieces.drop("_island")


def number_runs(pieces: DataFrame, keys: list[str], chunk: int) -> tuple[DataFrame, list[str]]:
    """Pieces with columns that those of one stretch have in common, and the names of these.

    Only pieces that reach a border of their chunk can go on in another one; they meet in one
    group per key, of two pieces a chunk at most. The others keep to their chunk.
    """
    begin = F.col("_chunk") * F.lit(chunk)
    border = (F.col("first") == begin) | (F.col("last") == begin + F.lit(chunk - 1))
    placed = pieces.withColumn("_place", F.when(~border, F.col("_chunk")))
    linked = Window.partitionBy(*keys, "_place").orderBy("first")
    starts = F.coalesce(F.lag("last").over(linked) != F.col("first") - 1, F.lit(True))
    marked = placed.withColumn("_starts", starts.cast("int"))
    return marked.withColumn("_run", F.sum("_starts").over(linked)).drop("_starts"), [*keys, "_place", "_run"]


def run_bounds(df: DataFrame, keys: list[str], order: str, chunk: int) -> DataFrame:
    """Add ``starts_run`` and ``ends_run`` for stretches of consecutive integers.

    Rows at the border of a chunk are copied to the chunk beside it, so one window shows each
    row whether its neighbours are there.
    """
    x = F.col(order)
    near = F.array_distinct(F.array(floor_div(x - 1, chunk), floor_div(x, chunk), floor_div(x + 1, chunk)))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    rows = df.withColumn("_chunk", F.explode(near)).withColumns(
        {
            "starts_run": F.coalesce(F.lag(order).over(inside) != x - 1, F.lit(True)),
            "ends_run": F.coalesce(F.lead(order).over(inside) != x + 1, F.lit(True)),
        }
    )
    return rows.where(floor_div(x, chunk) == F.col("_chunk")).drop("_chunk")


def runs(df: DataFrame, keys: list[str], order: str, chunk: int) -> DataFrame:
    """Stretches of consecutive integers: one row ``keys, first, last`` per stretch.

    ``df`` has each (key, ``order``) once. The rows are shuffled once, then one row per stretch
    and chunk.
    """
    pieces, whole = number_runs(run_pieces(df.select(*keys, order), keys, order, chunk), keys, chunk)
    return pieces.groupBy(*whole).agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_place", "_run")
