"""Range functions on a stream of metric samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweir.functions.timing import micros
from netweir.operators.vectors import SERIES, _counter_step, _panes_per_range, scale


def _growth(parts: Column, first: str, last: str) -> Column:
    """Growth from each part of a sorted array to the next, resets corrected."""
    link = lambda x, i: _counter_step(F.get(parts, i).getField(last), x.getField(first))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.aggregate(F.transform(rest, link), F.lit(0.0), lambda total, x: total + x)


def increase_stream(samples: DataFrame, range_s: int, step_s: int, late_s: int = 0, keys: list[str] = SERIES) -> DataFrame:
    """Counter growth inside each range ``[t - range, t)``, as ``vectors.increase`` gives it.

    Samples come in any order up to ``late_s``. Two windows follow each other: one gathers the
    readings of a series within a step and reduces them, once the watermark has passed, to a pane
    (first and last reading, growth inside, number of readings); the other links the panes of a
    range over their seams. A grid point comes out once, when no sample can reach it any more; a
    row of any other series moves the clock. State holds the readings of open steps and
    ``range / step`` copies of the panes of open ranges, each under its own series and window, and
    goes with them. Repeated rows are further readings; null values and times are no readings.
    """
    _panes_per_range(range_s, step_s)
    reading = F.struct(micros(F.col("ts")).alias("us"), F.col("value").cast("double").alias("value"))
    rows = samples.where("value is not null and ts is not null").select(*keys, "ts", reading.alias("reading")).withWatermark("ts", f"{late_s} seconds")
    steps = rows.groupBy(*keys, F.window("ts", f"{step_s} seconds").alias("pane")).agg(F.array_sort(F.collect_list("reading")).alias("r"))
    panes = steps.select(
        *keys,
        F.window_time("pane").alias("at"),
        F.struct(
            F.col("pane.end").alias("end"), F.size("r").alias("n"), F.get("r", F.lit(0))["value"].alias("first_value"),
            F.element_at("r", -1)["value"].alias("last_value"), _growth(F.col("r"), "value", "value").alias("inner_growth"),
        ).alias("part"),
    )
    ranges = panes.groupBy(*keys, F.window("at", f"{range_s} seconds", f"{step_s} seconds").alias("w")).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    total = lambda name: F.aggregate(F.col("parts"), F.lit(0.0), lambda sum_, x: sum_ + x.getField(name))
    return ranges.where(total("n") >= 2).select(
        *keys, F.col("w.end").cast("timestamp_ntz").alias("t"), (total("inner_growth") + _growth(F.col("parts"), "first_value", "last_value")).alias("value")
    )


def rate_stream(samples: DataFrame, range_s: int, step_s: int, late_s: int = 0, keys: list[str] = SERIES) -> DataFrame:
    """Counter growth per second, once no sample can change it."""
    return scale(increase_stream(samples, range_s, step_s, late_s, keys), lambda v: v / F.lit(float(range_s)))
