"""Alert life cycle against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from netweir.operators import alerts as al

EPOCH = dt.datetime(2024, 1, 1)
STEP = 60


def active_rows(seed, n=300):
    rnd = random.Random(seed)
    return [(k, i) for k in ("hot", "a", "b") for i in range(n) if rnd.random() < 0.85]


def frame(spark, rows):
    data = [(k, EPOCH + dt.timedelta(seconds=i * STEP), 1.0) for k, i in rows]
    return spark.createDataFrame(data, "series_key string, t timestamp, value double").repartition(4)


def islands(rows):
    out = {}
    for k in {k for k, _ in rows}:
        points = sorted(i for key, i in rows if key == k)
        start = previous = None
        for i in points:
            if previous is None or i != previous + 1:
                start = i
            out[(k, i)] = start
            previous = i
    return out


@pytest.mark.parametrize("for_s,need", [(0, 0), (60, 1), (300, 5), (90, 2)])
@pytest.mark.parametrize("chunk", [8, 512])
def test_states(spark, monkeypatch, for_s, need, chunk):
    monkeypatch.setattr(al, "CHUNK", chunk)
    rows = active_rows(for_s)
    rule = al.Rule("R", "warning", for_s)
    # A second rule with another wait goes through the same pass.
    both = al.with_rule(frame(spark, rows), rule, STEP).unionByName(al.with_rule(frame(spark, rows), al.Rule("S", "info", 120), STEP))
    got = al.states(both, [al.need_of(rule, STEP), 2], STEP).where("alertname = 'R'").collect()
    begin = int(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp()) // STEP
    found = {(r.series_key, int(r.t.replace(tzinfo=dt.timezone.utc).timestamp()) // STEP - begin): (r.alertstate, r.just_fired) for r in got}
    want = {
        key: ("firing" if key[1] - start >= need else "pending", key[1] - start == need)
        for key, start in islands(rows).items()
    }
    assert found == want and len(got) == len(rows)


@pytest.mark.parametrize("chunk", [4, 512])
def test_intervals_match_states(spark, monkeypatch, chunk):
    monkeypatch.setattr(al, "CHUNK", chunk)
    rows = active_rows(9)
    rule = al.Rule("R", "critical", 300)
    found = al.intervals(al.with_rule(frame(spark, rows), rule, STEP), STEP).collect()
    starts = islands(rows)
    ends = {}
    for (k, i), start in starts.items():
        ends[(k, start)] = max(i, ends.get((k, start), i))
    at = lambda i: EPOCH + dt.timedelta(seconds=i * STEP)
    want = {
        (k, at(s), at(s + 5) if e - s >= 5 else None, at(e + 1)) for (k, s), e in ends.items()
    }
    assert {(r.series_key, r.active_at, r.firing_at, r.resolved_at) for r in found} == want


@pytest.mark.parametrize(
    "severity,receiver,repeat",
    [("critical", "pagerduty", 300), ("warning", "slack", 3600), ("info", "email", 43200), ("other", "default", 14400)],
)
def test_routes(spark, severity, receiver, repeat):
    row = al.routed(spark.createDataFrame([(severity,)], "severity string")).first()
    assert (row.receiver, row.repeat_s) == (receiver, repeat)


def test_annotation_text(spark):
    row = spark.sql("""SELECT '{"instance":"r1"}' AS k, 81.0D AS whole, 81.5D AS part""")
    text = "High CPU on {instance} ({value}%) {absent}!"
    got = row.select(al.annotation(text, F.col("k"), F.col("whole")), al.annotation(text, F.col("k"), F.col("part"))).first()
    assert tuple(got) == ("High CPU on r1 (81%) !", "High CPU on r1 (81.5%) !")


def test_rules_keep_their_waits():
    waits = {n: (r.severity, r.for_s) for n, r in al.RULES.items()}
    assert waits["DeviceUnreachable"] == ("critical", 120)
    assert waits["BGPSessionDown"] == ("critical", 60)
    assert waits["HighCPU"] == ("warning", 300)
    assert waits["TargetSyncStale"] == ("warning", 900)


def brute_schedule(steps, wait, every, repeat):
    """Tick by tick: first look after the wait, then every interval."""
    out, last = [], None
    changed = {i for i, new in steps if new}
    present = {i for i, _ in steps}
    for start in sorted(i for i in present if i - 1 not in present):
        end = start
        while end + 1 in present:
            end += 1
        tick, notified, seen = start * STEP + wait, None, start - 1
        repeat_ticks = -(-repeat // every) * every
        while tick < (end + 1) * STEP:
            fresh = any(seen < c <= tick // STEP and c * STEP <= tick for c in changed if start <= c <= end)
            if fresh or notified is None or tick - notified >= repeat_ticks:
                out.append((tick, "new" if fresh or notified is None else "repeat"))
                notified = tick
            seen = tick // STEP
            tick += every
    return out


def test_notifications(spark):
    rnd = random.Random(4)
    present = [i for i in range(400) if rnd.random() < 0.97]
    steps = [(i, i - 1 not in present or rnd.random() < 0.05) for i in present]
    data = [("A", "dc", "d", EPOCH + dt.timedelta(seconds=i * STEP), new, 600) for i, new in steps]
    firing = spark.createDataFrame(
        data, "alertname string, datacenter string, device string, t timestamp, just_fired boolean, repeat_s int"
    )
    got = al.notifications(firing, al.GROUP_BY, STEP, wait_s=30, interval_s=300).collect()
    found = sorted((int((r.notify_at - EPOCH).total_seconds()), r.reason) for r in got)
    assert found == brute_schedule(steps, 30, 300, 600)


def test_anomaly_needs_more_than_two_sigma(spark):
    rows = [(1, EPOCH + dt.timedelta(seconds=300 * i), b) for i, b in enumerate([10, 20, 10, 20, 10, 20, 90, 15])]
    flows = spark.createDataFrame(rows, "exporter_ip bigint, ts timestamp, bytes bigint")
    got = {r.t: r for r in al.flow_anomalies(flows, 300, 6).collect()}
    spike = got[EPOCH + dt.timedelta(seconds=1800)]
    assert spike.is_anomaly and spike.baseline_mean == 15.0 and spike.baseline_stddev == 5.0
    assert sum(r.is_anomaly for r in got.values()) == 1
