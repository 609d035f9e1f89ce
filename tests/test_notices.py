"""Streams with timers against batch: in any batches, in any order within the lateness."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from netweir.operators import alerts as al
from netweir.plans import stream_queries as sq
from netweir.session import work_dir
from netweir.streaming import alerts as sa
from netweir.streaming import flows as sf_
from netweir.streaming import notices as sn
from netweir.streaming.notices import MICRO, Session

STEP, WAIT, EVERY = 60, 30, 300
EPOCH = dt.datetime(2024, 1, 1)


def firing_steps(seed, n=260, gap=0.2):
    """{k: (changed, repeat_s)}: sessions whose first step has a change."""
    rnd, out, on = random.Random(seed), {}, False
    for k in range(n):
        on = rnd.random() > gap if not on else rnd.random() > gap / 6
        if on:
            out[k] = (1 if k - 1 not in out or rnd.random() < 0.1 else 0, rnd.choice([300, 900, 3600]))
    return out


def plain(steps):
    """Look at the group every EVERY seconds from WAIT after its first step on."""
    out, ks = [], sorted(steps)
    for first in (k for k in ks if k - 1 not in steps):
        last = first
        while last + 1 in steps:
            last += 1
        start, end, told, pending = first * STEP + WAIT, (last + 1) * STEP, None, set()
        joined = [k for k in range(first, last + 1) if steps[k][0]]
        look = start
        while True:
            ahead = [k for k in ks if k * STEP > last * STEP]
            if look >= end:
                if told is not None and (not ahead or ahead[0] * STEP > look):
                    out.append((look, "resolved"))
                break
            pending = {k for k in joined if k * STEP <= look} - {k for k in joined if told is not None and k * STEP <= told}
            repeat = steps[min(look // STEP, last)][1]
            if pending:
                out.append((look, "new"))
                told = look
            elif told is not None and look >= told + -(-repeat // EVERY) * EVERY:
                out.append((look, "repeat"))
                told = look
            look += EVERY
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_session_against_looking_every_time(seed):
    """With one repeat interval for all steps, the state machine is the plain loop."""
    steps = {k: (c, 900) for k, (c, _) in firing_steps(seed).items()}
    session, got = Session(STEP * MICRO, WAIT * MICRO, EVERY * MICRO), []
    for k in sorted(steps):
        got += session.step(k, bool(steps[k][0]), steps[k][1])
    got += session.ended()
    assert [(at // MICRO, why) for at, why in got] == plain(steps)


def run_stream(spark, rows, batches, sink):
    """``rows`` (with ``order``) in so many arrivals, then a row of the clock alone."""
    checkpoint, out = work_dir(spark, "checkpoint"), work_dir(spark, "out")
    sq.in_arrivals(spark, rows, F.col("order"), batches, lambda stream: sf_.run_available(sink(stream).writeStream.format("parquet").option("path", out), checkpoint))
    return spark.read.parquet(out)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_notices_do_not_depend_on_batches(spark, batches):
    rnd, rows = random.Random(4), []
    for g in range(5):
        for k, (changed, _) in firing_steps(g).items():
            for _ in range(rnd.randint(1, 2)):  # alerts of one group, each its own row
                rows.append((f"g{g}", k + 10_000, changed, 900, k + 10_000 + rnd.randint(0, 4)))
    rows.append(("", 20_000, 0, 900, 20_000))
    given = spark.createDataFrame(rows, "g string, k long, changed int, repeat_s long, order long")
    with sq.keyed_states(spark):
        got = run_stream(spark, given, batches, lambda s: sn.notice_stream(s.drop("order"), ["g"], STEP, WAIT, EVERY, 5 * STEP))
        found = sorted((r.g, r.notify_at, r.reason) for r in got.where("g != ''").collect())
    want = [(f"g{g}", dt.datetime(1970, 1, 1) + dt.timedelta(seconds=10_000 * STEP + at), why) for g in range(5) for at, why in plain({k: (c, 900) for k, (c, _) in firing_steps(g).items()})]
    assert found == sorted(want)
    alerts = given.where("g != ''").select(
        "g", F.timestamp_seconds(F.col("k") * STEP).cast("timestamp_ntz").alias("t"), (F.col("changed") == 1).alias("just_fired"), "repeat_s"
    )
    batch = al.notifications(alerts, ["g"], STEP, WAIT, EVERY, resolved=True)
    assert sorted((r.g, r.notify_at, r.reason) for r in batch.collect()) == found


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_intervals_do_not_depend_on_batches(spark, batches):
    rnd, rows = random.Random(5), []
    for s in range(6):
        for k in firing_steps(s + 20, gap=0.4):
            rows.append(("rule", "warning", 2, f"s{s}", EPOCH + dt.timedelta(seconds=STEP * k), k + rnd.randint(0, 3)))
    end = 5000
    rows.append(("", "", 0, "", EPOCH + dt.timedelta(seconds=STEP * end), end))
    given = spark.createDataFrame(rows, "alertname string, severity string, need int, series_key string, t timestamp, order long")
    got = run_stream(spark, given, batches, lambda s: sa.interval_stream(s.drop("order"), STEP, 4 * STEP)).where("alertname != ''")
    active = given.where("alertname != ''").select("alertname", "severity", "need", "series_key", "t", F.lit(1.0).alias("value"))
    want = al.intervals(active, STEP)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 20


def test_a_group_has_its_state_once_a_batch():
    """However many steps come for a group: one state, one timer."""

    class State:
        exists, updates, timers = False, [], []

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, row):
            self.updates.append(row)

        def setTimeoutTimestamp(self, ms):
            self.timers.append(ms)

    state, rows = State(), pd.DataFrame({"k": [12, 10, 11, 10], "changed": [0, 0, 0, 1], "repeat_s": [900, 900, 900, 300]})
    assert list(sn.Notices(["g"], STEP, WAIT, EVERY)(("a",), iter([rows]), state)) == []
    assert len(state.updates) == 1 and state.updates[0][5:] == ([10, 11, 12], [1, 0, 0], [300, 900, 900])
    assert state.timers == [11 * STEP * 1000 - 1]


@pytest.mark.parametrize("buckets", [1, 4, None])
def test_groups_in_one_row_of_state(spark, buckets):
    """Groups that share a state are not taken for each other; a key may be NULL."""
    rows = [(None if g == 2 else f"g{g}", k + 10_000, changed, 900, k + 10_000) for g in range(6) for k, (changed, _) in firing_steps(g + 40, 60).items()]
    given = spark.createDataFrame([*rows, ("", 20_000, 0, 900, 20_000)], "g string, k long, changed int, repeat_s long, order long")
    with sq.keyed_states(spark):
        got = run_stream(spark, given, 3, lambda s: sn.notice_stream(s.drop("order"), ["g"], STEP, WAIT, EVERY, STEP, buckets))
        found = sorted((str(r.g), r.notify_at, r.reason) for r in got.where("g is null or g != ''").collect())
    want = [
        (str(None if g == 2 else f"g{g}"), dt.datetime(1970, 1, 1) + dt.timedelta(seconds=10_000 * STEP + at), why)
        for g in range(6) for at, why in plain({k: (c, 900) for k, (c, _) in firing_steps(g + 40, 60).items()})
    ]
    assert found == sorted(want)


def test_python_is_called_once_a_bucket():
    """However many groups: one state, one timer, the earliest of all."""

    class State:
        exists, updates, timers = False, [], []

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, row):
            self.updates.append(row)

        def setTimeoutTimestamp(self, ms):
            self.timers.append(ms)

    state, rows = State(), pd.DataFrame({"g": ["a", "b", "c"], "k": [12, 10, 11], "changed": [1, 1, 1], "repeat_s": [900] * 3})
    assert list(sn.BucketNotices(sn.Notices(["g"], STEP, WAIT, EVERY))(iter([rows]), state)) == []
    assert len(state.updates) == 1 and state.timers == [11 * STEP * 1000 - 1]
