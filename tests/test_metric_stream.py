"""Range functions on streams against batch: in any batches, in any order within the lateness."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from netweir.operators import vectors as m
from netweir.plans import stream_queries as sq
from netweir.session import work_dir
from netweir.streaming import flows as sf_
from netweir.streaming import metrics as sm

EPOCH = dt.datetime(2024, 1, 1)
STEP, RANGE, LATE = 60, 300, 240
SCHEMA = "series_key string, ts timestamp, value double, order long"


def readings(seed):
    """Counters with resets, silences, repeated moments and rows that come late."""
    rnd, rows = random.Random(seed), []
    for s in range(5):
        value = 0
        for at in range(0, 4000, 20):
            value = rnd.randint(0, 50) if rnd.random() < 0.03 else value + rnd.randint(0, 900)
            if rnd.random() < 0.5 and not 1500 < at < 1500 + 300 * s:
                rows.append((f"s{s}", EPOCH + dt.timedelta(seconds=at), float(value), at + rnd.randint(0, LATE - 1)))
                if rnd.random() < 0.1:
                    rows.append((f"s{s}", EPOCH + dt.timedelta(seconds=at), float(value + rnd.randint(0, 5)), at + rnd.randint(0, LATE - 1)))
    return rows


def run_stream(spark, rows, batches):
    checkpoint, out = work_dir(spark, "checkpoint"), work_dir(spark, "out")

    def process(stream):
        writer = sm.increase_stream(stream.drop("order"), RANGE, STEP, LATE).writeStream.format("parquet").option("path", out)
        sf_.run_available(writer, checkpoint)

    sq.in_arrivals(spark, rows, F.col("order"), batches, process)
    return sorted(map(tuple, spark.read.parquet(out).where("series_key != ''").select("series_key", "t", "value").collect()))


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_increase_does_not_depend_on_batches(spark, batches):
    given = readings(2)
    noise = [("s0", EPOCH + dt.timedelta(seconds=100), None, 100), ("", EPOCH + dt.timedelta(seconds=90_000), 0.0, 6000)]
    got = run_stream(spark, spark.createDataFrame(given + noise, SCHEMA), batches)
    want = sorted(map(tuple, m.increase(spark.createDataFrame(given, SCHEMA), RANGE, STEP).collect()))
    assert got == want and len(got) > 200


def test_a_point_waits_for_the_watermark(spark):
    """Without a later row nothing is final; a range with one reading gives nothing."""
    at = lambda s: EPOCH + dt.timedelta(seconds=s)
    rows = [("a", at(5), 10.0, 0), ("a", at(50), 4.0, 1), ("b", at(5), 1.0, 1)]
    assert run_stream(spark, spark.createDataFrame(rows, SCHEMA), 1) == []
    got = run_stream(spark, spark.createDataFrame([*rows, ("", at(90_000), 0.0, 2)], SCHEMA), 1)
    assert got == [("a", at(60 * k), 4.0) for k in range(1, 6)]
