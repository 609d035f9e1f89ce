"""Time-series expressions on an evaluation grid.

Samples are rows ``metric, labels, series_key, ts, value``. A vector is rows
``series_key, t, value`` with ``t`` a multiple of the step. A range ``r`` at ``t``
covers ``[t - r, t)``; an instant lookup at ``t`` covers ``(t - lookback, t]``.

Samples are first reduced to panes of one step. Windows then run over panes, cut into
overlapping chunks of the time axis, so the work of one task is bounded by the chunk
and not by how long or how busy a series is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions.labels import equals, label, matches, series_key
from netweir.functions.timing import floor_div, grid_time, micros
from netweir.operators.ordered import overlapping_chunks, with_neighbors

CHUNK_PANES = 512
MICRO = 1_000_000
# What tells series apart. With ["metric", "series_key"] several metrics go through one pass.
SERIES = ["series_key"]


# ------------------------------------------------------------ selection

def select_series(
    samples: DataFrame,
    metric: str,
    equal: dict[str, str] | None = None,
    regex: dict[str, str] | None = None,
) -> DataFrame:
    """Samples of one metric whose labels meet all matchers."""
    chosen = samples.where(F.col("metric") == metric)
    for name, value in (equal or {}).items():
        chosen = chosen.where(equals(F.col("labels"), name, value))
    for name, pattern in (regex or {}).items():
        chosen = chosen.where(matches(F.col("labels"), name, pattern))
    return chosen


def label_values(samples: DataFrame, name: str) -> DataFrame:
    """Distinct non-empty values of a label."""
    return samples.select(F.col("labels").getItem(name).alias(name)).where(F.coalesce(name, F.lit("")) != "").distinct()


# ------------------------------------------------------------ panes

def _with_pane(samples: DataFrame, step_s: int, include_end: bool, keys: list[str]) -> DataFrame:
    """Add ``us`` and the index ``k`` of the grid point that closes the sample's pane."""
    us = micros(F.col("ts"))
    width = step_s * MICRO
    pane = -floor_div(-us, width) if include_end else floor_div(us, width) + 1
    return samples.select(*keys, "value", us.alias("us"), pane.alias("k"))


def _counter_step(previous: Column, current: Column) -> Column:
    """Growth between two counter readings; after a reset the reading itself."""
    return F.when(current < previous, current).otherwise(current - previous)


def _at_last(time: str, value: str) -> Column:
    """The value at the latest time; of readings with the same time the greatest."""
    return F.max(F.struct(time, value)).getField(value)


def _at_first(time: str, value: str) -> Column:
    """The value at the earliest time; of readings with the same time the least."""
    return F.min(F.struct(time, value)).getField(value)


def gauge_panes(
    samples: DataFrame, step_s: int, include_end: bool = False, keys: list[str] = SERIES
) -> DataFrame:
    return (
        _with_pane(samples, step_s, include_end, keys)
        .groupBy(*keys, "k")
        .agg(
            F.count("value").alias("n"),
            F.sum("value").alias("total"),
            _at_last("us", "value").alias("last_value"),
        )
    )


def counter_panes(samples: DataFrame, step_s: int, keys: list[str] = SERIES) -> DataFrame:
    """Per pane: first and last reading, growth inside the pane, number of readings."""
    inside = Window.partitionBy(*keys, "k").orderBy("us", "value")
    return (
        _with_pane(samples, step_s, False, keys)
        .withColumn("grown", _counter_step(F.lag("value").over(inside), F.col("value")))
        .groupBy(*keys, "k")
        .agg(
            F.count("value").alias("n"),
            F.coalesce(F.sum("grown"), F.lit(0.0)).alias("inner_growth"),
            _at_first("us", "value").alias("first_value"),
            _at_last("us", "value").alias("last_value"),
        )
    )


def _panes_per_range(range_s: int, step_s: int) -> int:
    if range_s % step_s:
        raise ValueError("the range has to be a multiple of the step")
    return range_s // step_s


def _reached(panes: DataFrame, width: int, keys: list[str], *more) -> DataFrame:
    """Spread panes over the grid points ``e`` they reach, after one window over the panes.

    A pane stands at its own grid point and, until the next pane of the series begins, at the
    points where a window still reaches back to it. So exactly the points with a non-empty window
    exist, each once, and nothing is sorted after the spreading. ``more`` makes columns of a pane
    from the window of its series and chunk.
    """
    chunk = max(width, CHUNK_PANES)
    copies = overlapping_chunks(panes, "k", width - 1, chunk)
    along = Window.partitionBy(*keys, "_chunk").orderBy("k")
    for make in more:
        copies = copies.withColumns(make(along))
    start = F.col("_chunk") * chunk
    low = F.greatest(F.col("k"), start)
    high = F.least(F.col("k") + (width - 1), start + (chunk - 1), F.col("_following"))
    copies = copies.withColumns({"_following": F.lead("k").over(along) - 1}).withColumns({"_low": low, "_high": high})
    return copies.where(F.col("_high") >= F.col("_low")).withColumn("e", F.explode(F.sequence("_low", "_high")))


def _finish(rows: DataFrame, value: Column, step_s: int, keys: list[str]) -> DataFrame:
    return rows.select(*keys, grid_time(F.col("e"), step_s).alias("t"), value.alias("value"))


# ------------------------------------------------------------ range functions

def increase(samples: DataFrame, range_s: int, step_s: int, keys: list[str] = SERIES) -> DataFrame:
    """Counter growth inside each range, resets corrected; ranges with one reading give none."""
    width = _panes_per_range(range_s, step_s)

    def link(along) -> dict[str, Column]:
        return {"_link": F.coalesce(_counter_step(F.lag("last_value").over(along), F.col("first_value")), F.lit(0.0))}

    def add_up(along) -> dict[str, Column]:
        return {"high": F.sum(F.col("_link") + F.col("inner_growth")).over(along)}

    def gather(along) -> dict[str, Column]:
        pane = F.struct("k", "n", "high", (F.col("high") - F.col("inner_growth")).alias("low"))
        return {"_panes": F.collect_list(pane).over(along.rangeBetween(-(width - 1), 0))}

    points = _reached(counter_panes(samples, step_s, keys), width, keys, link, add_up, gather)
    within = F.filter("_panes", lambda p: p["k"] > F.col("e") - width)
    readings = F.aggregate("_w", F.lit(0).cast("long"), lambda s, p: s + p["n"])
    growth = F.array_max(F.transform("_w", lambda p: p["high"])) - F.array_min(F.transform("_w", lambda p: p["low"]))
    windowed = points.select(*keys, "e", within.alias("_w")).where(readings >= 2)
    return _finish(windowed, growth, step_s, keys)


def rate(samples: DataFrame, range_s: int, step_s: int, keys: list[str] = SERIES) -> DataFrame:
    """Counter growth per second."""
    return scale(increase(samples, range_s, step_s, keys), lambda v: v / F.lit(float(range_s)))


def avg_over_time(samples: DataFrame, range_s: int, step_s: int, keys: list[str] = SERIES) -> DataFrame:
    width = _panes_per_range(range_s, step_s)

    def gather(along) -> dict[str, Column]:
        return {"_panes": F.collect_list(F.struct("k", "n", "total")).over(along.rangeBetween(-(width - 1), 0))}

    points = _reached(gauge_panes(samples, step_s, keys=keys), width, keys, gather)
    within = F.filter("_panes", lambda p: p["k"] > F.col("e") - width)
    total = F.aggregate(F.filter("_w", lambda p: p["total"].isNotNull()), F.lit(None).cast("double"), lambda s, p: F.coalesce(s + p["total"], p["total"]))
    mean = total / F.aggregate("_w", F.lit(0).cast("long"), lambda s, p: s + p["n"])
    return _finish(points.select(*keys, "e", within.alias("_w")), mean, step_s, keys)


def on_grid(samples: DataFrame, step_s: int, lookback_s: int = 300, keys: list[str] = SERIES) -> DataFrame:
    """Newest reading not older than the lookback, at every grid point."""
    width = _panes_per_range(lookback_s, step_s)

    def newest(along) -> dict[str, Column]:
        seen = F.when(F.col("last_value").isNotNull(), F.struct("k", "last_value"))
        return {"_newest": F.last(seen, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))}

    points = _reached(gauge_panes(samples, step_s, True, keys), width, keys, newest)
    # A pane may hold nothing but NULLs; an older reading counts while the window reaches it.
    value = F.when(F.col("_newest.k") > F.col("e") - width, F.col("_newest.last_value"))
    return _finish(points, value, step_s, keys)


def instant(samples: DataFrame, at: str, lookback_s: int = 300) -> DataFrame:
    """Newest reading of each series at one moment."""
    moment = F.lit(at).cast("timestamp")
    return (
        samples.where((F.col("ts") <= moment) & (F.col("ts") > moment - F.expr(f"INTERVAL {lookback_s} SECONDS")))
        .groupBy("series_key")
        .agg(_at_last("ts", "value").alias("value"))
        .select("series_key", moment.cast("timestamp_ntz").alias("t"), "value")
    )


def carry_forward(samples: DataFrame, step_s: int, chunk_s: int = 86_400) -> DataFrame:
    """Grid from the first to the last reading of each series, gaps filled from before."""
    panes = gauge_panes(samples, step_s, include_end=True).select("series_key", "k", "last_value")
    chained = with_neighbors(panes, ["series_key"], "k", max(1, chunk_s // step_s), after={"k": "next_k"})
    until = F.coalesce(F.col("next_k") - 1, F.col("k"))
    return chained.select(
        "series_key", F.explode(F.sequence("k", until)).alias("e"), F.col("last_value").alias("value")
    ).select("series_key", grid_time(F.col("e"), step_s).alias("t"), "value")


def gaps(samples: DataFrame, interval_s: int, tolerance: int = 3, chunk_s: int = 86_400) -> DataFrame:
    """Stretches in which a series was silent for more than ``tolerance`` intervals."""
    slim = samples.select("series_key", micros(F.col("ts")).alias("us"))
    linked = with_neighbors(slim, ["series_key"], "us", chunk_s * MICRO, before={"us": "previous_us"})
    silent = F.col("us") - F.col("previous_us")
    return linked.where(silent > tolerance * interval_s * MICRO).select(
        "series_key",
        F.timestamp_micros("previous_us").cast("timestamp_ntz").alias("silent_from"),
        F.timestamp_micros("us").cast("timestamp_ntz").alias("silent_to"),
        (silent / F.lit(float(MICRO))).alias("gap_seconds"),
    )


# ------------------------------------------------------------ vector arithmetic

def scale(vector: DataFrame, fn) -> DataFrame:
    return vector.withColumn("value", fn(F.col("value")))


def keep_where(vector: DataFrame, condition) -> DataFrame:
    """Comparison filter; rows that pass keep their value."""
    return vector.where(condition(F.col("value")))


def combine(left: DataFrame, right: DataFrame, op) -> DataFrame:
    """One-to-one match on all labels; a result that is undefined (x / 0) gives no row."""
    other = right.select("series_key", "t", F.col("value").alias("_other"))
    joined = left.join(other, ["series_key", "t"])
    return joined.select("series_key", "t", op(F.col("value"), F.col("_other")).alias("value")).where(
        F.col("value").isNotNull()
    )


def ratio(left: Column, right: Column) -> Column:
    return F.try_divide(left, right)


def side_by_side(vectors: DataFrame, metrics: list[str]) -> DataFrame:
    """Values of several metrics (rows ``metric, series_key, t, value``) as columns.

    The same match on all labels as ``combine``, in one aggregation and without computing
    each side in a plan of its own. A metric without a value at that time is NULL.
    """
    columns = [F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name) for name in metrics]
    return vectors.groupBy("series_key", "t").agg(*columns)


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows, and right rows whose labels the left side does not have at that time."""
    columns = ["series_key", "t", "value"]
    ranked = left.select(*columns, F.lit(0).alias("_side")).unionByName(right.select(*columns, F.lit(1).alias("_side")))
    return ranked.groupBy("series_key", "t").agg(F.min_by("value", "_side").alias("value"))


def aggregate(vector: DataFrame, how: str, by: list[str] | None = None) -> DataFrame:
    """``count``, ``sum``, ``avg``, ``min`` or ``max`` over series, per time and label."""
    names = by or []
    fn = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[how]
    keyed = vector.select("t", "value", *[label(F.col("series_key"), n).alias(n) for n in names])
    return keyed.groupBy("t", *names).agg(fn("value").alias("value"))


def or_zero(total: DataFrame, times: DataFrame) -> DataFrame:
    """A global total at each of ``times``, 0 where the expression gave nothing."""
    return (
        times.select("t").distinct().join(total, "t", "left")
        .select("t", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    )


def count_or_zero(vector: DataFrame, condition, by: list[str] | None = None) -> DataFrame:
    """How many series meet the condition at each time, 0 where none does: one pass."""
    names = by or []
    keyed = vector.select("t", "value", *[label(F.col("series_key"), n).alias(n) for n in names])
    return keyed.groupBy("t", *names).agg(F.count_if(condition(F.col("value"))).cast("double").alias("value"))


def topk(vector: DataFrame, k: int, tie: list[str] | None = None) -> DataFrame:
    """The ``k`` largest rows of every evaluation time.

    The rank filter sits right above the window, so Spark trims to ``k`` rows per time
    in each map task before anything is shuffled.
    """
    ties = tie or [c for c in vector.columns if c not in ("t", "value")]
    ranked = Window.partitionBy("t").orderBy(F.desc("value"), *ties)
    return vector.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= k).drop("_rank")


def band(value: Column, steps: list[tuple[float, str]], base: str) -> Column:
    """Name of the highest threshold the value reaches; ``base`` below the first."""
    result = F.lit(base)
    for limit, name in sorted(steps):
        result = F.when(value >= limit, name).otherwise(result)
    return result


# ------------------------------------------------------------ store operations

def downsample(samples: DataFrame, width_s: int) -> DataFrame:
    """Mergeable summary per series and window, with the counter growth inside it."""
    us = micros(F.col("ts"))
    slim = samples.select("series_key", "value", us.alias("us"), floor_div(us, width_s * MICRO).alias("w"))
    inside = Window.partitionBy("series_key", "w").orderBy("us", "value")
    return (
        slim.withColumn("grown", _counter_step(F.lag("value").over(inside), F.col("value")))
        .groupBy("series_key", "w")
        .agg(
            F.count("value").alias("sample_count"),
            F.sum("value").alias("sample_sum"),
            F.min("value").alias("sample_min"),
            F.max("value").alias("sample_max"),
            _at_first("us", "value").alias("sample_first"),
            _at_last("us", "value").alias("sample_last"),
            F.coalesce(F.sum("grown"), F.lit(0.0)).alias("counter_growth"),
        )
        .select(grid_time(F.col("w"), width_s).alias("window_start"), "*")
        .drop("w")
    )


def downsample_further(fine: DataFrame, width_s: int) -> DataFrame:
    """Coarser summaries from finer ones, without the samples."""
    us = micros(F.col("window_start"))
    placed = fine.withColumn("us", us).withColumn("w", floor_div(us, width_s * MICRO))
    inside = Window.partitionBy("series_key", "w").orderBy("us")
    link = F.coalesce(_counter_step(F.lag("sample_last").over(inside), F.col("sample_first")), F.lit(0.0))
    return (
        placed.withColumn("link", link)
        .groupBy("series_key", "w")
        .agg(
            F.sum("sample_count").alias("sample_count"),
            F.sum("sample_sum").alias("sample_sum"),
            F.min("sample_min").alias("sample_min"),
            F.max("sample_max").alias("sample_max"),
            _at_first("us", "sample_first").alias("sample_first"),
            _at_last("us", "sample_last").alias("sample_last"),
            F.sum(F.col("counter_growth") + F.col("link")).alias("counter_growth"),
        )
        .select(grid_time(F.col("w"), width_s).alias("window_start"), "*")
        .drop("w")
    )


def _without(names: list[str]) -> Column:
    return F.map_filter(F.col("labels"), lambda k, _: ~k.isin(names))


def federate(stores: dict[str, DataFrame], external: dict[str, dict[str, str]]) -> DataFrame:
    """Union of stores; each store's external labels are added to its series."""
    result = None
    for name, samples in stores.items():
        entries = [F.lit(x) for pair in external[name].items() for x in pair]
        merged = samples.withColumn("labels", F.map_concat(_without(list(external[name])), F.create_map(*entries)))
        merged = merged.withColumn("series_key", series_key(F.col("labels")))
        result = merged if result is None else result.unionByName(merged, allowMissingColumns=True)
    return result


def drop_replicas(samples: DataFrame, replica_label: str = "replica") -> DataFrame:
    """One reading per series and time among replicas: that of the first replica by name."""
    keyed = samples.select(
        "metric", "ts", "value",
        series_key(F.col("labels"), [replica_label]).alias("series_key"),
        F.coalesce(F.col("labels").getItem(replica_label), F.lit("")).alias("_replica"),
    )
    return keyed.groupBy("metric", "series_key", "ts").agg(F.min_by("value", "_replica").alias("value"))
