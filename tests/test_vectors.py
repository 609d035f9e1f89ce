"""Range functions against brute force, with chunks shorter than the series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from netweir.functions.labels import series_key
from netweir.operators import vectors as m
from netweir.session import fine_partitions

EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
STEP, RANGE = 60, 300


def seconds(t):
    return int((t.replace(tzinfo=dt.timezone.utc) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds())


def readings(seed=1, n=400):
    """A hot counter with resets and two sparse ones."""
    rnd = random.Random(seed)
    out = []
    for name, mean, count in (("hot", 15, n), ("sparse", 400, 40), ("single", 5000, 3)):
        at, value = 0.0, 0
        for _ in range(count):
            at += rnd.choice([mean, mean * rnd.random() * 2, 60, 60])
            value = rnd.randrange(5) if rnd.random() < 0.03 else value + rnd.randrange(50)
            out.append((f'{{"s":"{name}"}}', round(at, 3), float(value)))
    return out


@pytest.fixture(params=[8, 512])
def chunk(request, monkeypatch):
    monkeypatch.setattr(m, "CHUNK_PANES", request.param)


@pytest.fixture(scope="module")
def rows():
    return readings()


@pytest.fixture(scope="module")
def samples(spark, rows):
    data = [(k, EPOCH + dt.timedelta(seconds=s), v) for k, s, v in rows]
    return spark.createDataFrame(data, "series_key string, ts timestamp, value double").repartition(4).cache()


def windows(rows, inside):
    base = int(EPOCH.timestamp())
    series = {}
    for k, s, v in rows:
        series.setdefault(k, []).append((base + s, v))
    for k, points in series.items():
        points.sort()
        for t in range(base - base % STEP, int(points[-1][0]) + RANGE + 2 * STEP, STEP):
            picked = [(s, v) for s, v in points if inside(s, t)]
            if picked:
                yield k, t, picked


def as_dict(vector):
    return {(r.series_key, seconds(r.t)): r.value for r in vector.collect()}


def test_increase(samples, rows, chunk):
    want = {}
    for k, t, picked in windows(rows, lambda s, t: t - RANGE <= s < t):
        if len(picked) >= 2:
            pairs = zip(picked, picked[1:])
            want[(k, t)] = sum(b - a if b >= a else b for (_, a), (_, b) in pairs)
    assert as_dict(m.increase(samples, RANGE, STEP)) == want


def test_average(samples, rows, chunk):
    want = {
        (k, t): sum(v for _, v in p) / len(p) for k, t, p in windows(rows, lambda s, t: t - RANGE <= s < t)
    }
    assert as_dict(m.avg_over_time(samples, RANGE, STEP)) == want


def test_newest_reading(samples, rows, chunk):
    want = {(k, t): p[-1][1] for k, t, p in windows(rows, lambda s, t: t - RANGE < s <= t)}
    assert as_dict(m.on_grid(samples, STEP, RANGE)) == want


def test_carry_forward_has_no_holes(samples, rows):
    got = as_dict(m.carry_forward(samples, STEP, chunk_s=600))
    base = int(EPOCH.timestamp())
    for key in {k for k, _, _ in rows}:
        points = sorted((base + s, v) for k, s, v in rows if k == key)
        times = sorted(t for k, t in got if k == key)
        assert times == list(range(times[0], times[-1] + STEP, STEP))
        for t in times:
            assert got[(key, t)] == [v for s, v in points if s <= t][-1]


def test_range_must_be_whole_steps(samples):
    with pytest.raises(ValueError):
        m.rate(samples, 100, 60)


def test_downsample_twice_equals_once(samples):
    once = m.downsample(samples, 3600).orderBy("series_key", "window_start").collect()
    twice = m.downsample_further(m.downsample(samples, 300), 3600).orderBy("series_key", "window_start").collect()
    assert [tuple(r) for r in once] == [tuple(r) for r in twice]


def vector(spark, rows):
    return spark.createDataFrame(rows, "series_key string, t timestamp, value double")


def test_division_by_zero_gives_no_row(spark):
    left = vector(spark, [("a", EPOCH, 1.0), ("b", EPOCH, 4.0)])
    right = vector(spark, [("a", EPOCH, 0.0), ("b", EPOCH, 2.0), ("c", EPOCH, 1.0)])
    assert [(r.series_key, r.value) for r in m.combine(left, right, m.ratio).collect()] == [("b", 2.0)]


def test_or_keeps_left_and_adds_missing(spark):
    left, right = vector(spark, [("a", EPOCH, 1.0)]), vector(spark, [("a", EPOCH, 9.0), ("b", EPOCH, 2.0)])
    assert sorted((r.series_key, r.value) for r in m.either(left, right).collect()) == [("a", 1.0), ("b", 2.0)]


def test_count_of_nothing_is_no_row_unless_or_zero(spark):
    times = vector(spark, [("a", EPOCH, 1.0)])
    none = m.aggregate(times.where("value > 5"), "count")
    assert none.collect() == []
    assert [r.value for r in m.or_zero(none, times).collect()] == [0.0]


def test_topk_ties_break_by_series(spark):
    rows = [(s, EPOCH, v) for s, v in (("c", 2.0), ("a", 2.0), ("b", 5.0))]
    assert {r.series_key for r in m.topk(vector(spark, rows), 2).collect()} == {"b", "a"}


def test_bands(spark):
    rows = vector(spark, [(str(v), EPOCH, float(v)) for v in (59, 60, 79, 80)])
    got = rows.select(m.band(F.col("value"), [(80, "red"), (60, "yellow")], "green").alias("b"))
    assert [r.b for r in got.collect()] == ["green", "yellow", "yellow", "red"]


def test_replica_dedup_is_idempotent(spark):
    rows = [
        ("m", {"i": "1", "replica": "a"}, EPOCH, 1.0), ("m", {"i": "1", "replica": "b"}, EPOCH, 2.0),
        ("m", {"i": "2", "replica": "b"}, EPOCH, 3.0),
    ]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double")
    once = m.drop_replicas(df)
    assert sorted((r.series_key, r.value) for r in once.collect()) == [('{"i":"1"}', 1.0), ('{"i":"2"}', 3.0)]
    from netweir.functions.labels import labels_of

    again = m.drop_replicas(once.withColumn("labels", labels_of(F.col("series_key"))))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))


def test_federated_labels_override(spark):
    df = spark.createDataFrame([("m", {"i": "1", "dc": "x"}, EPOCH, 1.0)], "metric string, labels map<string,string>, ts timestamp, value double")
    df = df.withColumn("series_key", series_key(F.col("labels")))
    got = m.federate({"s": df}, {"s": {"dc": "one"}}).first()
    assert got.series_key == '{"dc":"one","i":"1"}'


@pytest.mark.parametrize("make", [lambda s: m.increase(s, 240, 60), lambda s: m.avg_over_time(s, 240, 60), lambda s: m.on_grid(s, 60, 240)])
def test_nothing_is_sorted_after_spreading(spark, make):
    """Grid points follow from panes: no window over the points, which are many times the panes."""
    given = spark.createDataFrame([("s", dt.datetime(2024, 1, 1), 1.0)], "series_key string, ts timestamp, value double")
    plan = make(given)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Window" not in plan[: plan.index("Generate")]


def test_shuffles_of_the_queries_are_cut_finely(spark):
    fine_partitions(spark)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 512
