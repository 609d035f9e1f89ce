"""Streams against batch, and what happens around restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from netweir.operators import rollup
from netweir.operators.alerts import Rule, states, with_rule
from netweir.plans import views as v
from netweir.schema import MINUTE_KEYS
from netweir.sources.flows import read_flow_files
from netweir.streaming import alerts as sa
from netweir.streaming import executions as se
from netweir.streaming import flows as sf_

EPOCH = dt.datetime(2024, 1, 1)


def at(s):
    return EPOCH + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def flows(spark, sf_dir):
    return v.event_flows(spark, sf_dir)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_a_repeated_batch_does_not_count_twice(spark, flows, tmp_path):
    sink = sf_.write_partials(str(tmp_path))
    early, late = flows.where(F.hour("ts") < 12), flows.where(F.hour("ts") >= 12)
    for batch, number in ((early, 0), (late, 1), (late, 1)):
        sink(batch, number)
    assert same(sf_.read_tier(spark, str(tmp_path), "1m").select(*MINUTE_KEYS, "flow_count"),
                rollup.rollup_1m(flows).select(*MINUTE_KEYS, "flow_count"))
    assert spark.read.parquet(f"{tmp_path}/raw").count() == flows.count()


def test_stream_restart_continues_from_the_checkpoint(spark, flows, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (F.hour("ts") < 6, F.hour("ts") >= 6):
        flows.where(part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        sf_.run_available(stream.writeStream.foreachBatch(sf_.write_partials(out)), checkpoint)
    assert sf_.read_tier(spark, out, "1h").agg(F.sum("flow_count")).first()[0] == flows.count()


def test_wire_files_are_a_stream(spark, sf_dir, tmp_path):
    wire = v.event_wire(v.table(spark, sf_dir, "events"))
    wire.write.parquet(str(tmp_path / "wire"))
    assert read_flow_files(spark, str(tmp_path / "wire"), 1).isStreaming


def test_refresh_keeps_the_last_good_copy(spark, sf_dir, tmp_path):
    calls = []

    def loader():
        calls.append(1)
        if len(calls) > 1:
            raise OSError("gone")
        return v.dimensions(spark, sf_dir)

    lookups = sf_.RefreshingDimensions(spark, loader, str(tmp_path), refresh_s=0)
    first = lookups.get()
    assert lookups.get() is first and len(calls) == 2


def test_first_load_has_to_work(spark, tmp_path):
    def loader():
        raise OSError("gone")

    with pytest.raises(OSError):
        sf_.RefreshingDimensions(spark, loader, str(tmp_path)).get()


def test_fresh_copy_is_not_loaded_again(spark, sf_dir, tmp_path):
    calls = []

    def loader():
        calls.append(1)
        return v.dimensions(spark, sf_dir)

    lookups = sf_.RefreshingDimensions(spark, loader, str(tmp_path), refresh_s=300)
    lookups.get(), lookups.get()
    assert len(calls) == 1


def test_alert_states_across_batches_and_a_retry(spark, tmp_path):
    rows = [("a", at(60 * i), 1.0) for i in range(12) if i != 7] + [("b", at(60 * i), 1.0) for i in range(5, 9)]
    active = spark.createDataFrame(rows, "series_key string, t timestamp, value double")
    rule = Rule("R", "warning", 180)
    sink = sa.evaluate_batches(rule, 60, str(tmp_path))
    cuts = [0, 2, 6, 7, 12]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
        batch = active.where((F.col("t") >= F.lit(at(60 * low))) & (F.col("t") < F.lit(at(60 * high))))
        sink(batch, n)
        sink(batch, n)
    got = sa.read_states(spark, str(tmp_path))
    assert same(got, states(with_rule(active, rule, 60), [3], 60).select(*got.columns))


@pytest.mark.parametrize("batches", [[[0, 1, 3, 4], [2]], [[0], [4], [2, 3], [1]], [[4, 3], [2, 1, 0]]])
def test_late_steps_are_judged_again(spark, tmp_path, batches):
    rule = Rule("R", "warning", 120)
    frame = lambda steps: spark.createDataFrame([("a", at(60 * i), 1.0) for i in steps], "series_key string, t timestamp, value double")
    sink = sa.evaluate_batches(rule, 60, str(tmp_path), late_s=600)
    for n, steps in enumerate(batches):
        sink(frame(steps), n)
    got = sa.read_states(spark, str(tmp_path))
    assert same(got, states(with_rule(frame(range(5)), rule, 60), [2], 60).select(*got.columns))


def test_executions_time_out_only_while_waiting(spark, tmp_path):
    schema = "execution string, phase string, ts timestamp, start_time timestamp, approval_timeout string"
    batches = [
        [("a", "PendingApproval", at(0), None, "30m"), ("b", "PendingApproval", at(0), None, "30m"), ("c", "PendingApproval", at(0), None, "")],
        [("b", "Approved", at(600), None, "30m")],
        [("b", "Completed", at(4000), at(601.4), "30m")],
    ]
    sink = se.track_batches(str(tmp_path))
    for n, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), n)
    got = {(r.execution, r.phase, r.at, r.duration_s) for r in spark.read.parquet(f"{tmp_path}/ended").collect()}
    assert got == {
        ("a", "TimedOut", at(1800), None), ("c", "TimedOut", at(3600), None), ("b", "Completed", at(4000), 3399),
    }


@pytest.mark.parametrize("cuts", [[], [1], [2, 4], [1, 2, 3, 4, 5, 6]])
def test_an_execution_ends_once_however_batches_are_cut(spark, tmp_path, cuts):
    rows = [
        ("a", "PendingApproval", at(0), None, "30m"), ("b", "PendingApproval", at(10), None, "2h"), ("b", "Approved", at(600), None, "2h"),
        ("c", "Completed", at(700), at(100), None), ("b", "Completed", at(4000), at(601.4), "2h"), ("a", "Approved", at(5000), None, "30m"),
        ("a", "Completed", at(5100), at(5001), "30m"),
    ]
    schema = "execution string, phase string, ts timestamp, start_time timestamp, approval_timeout string"
    sink = se.track_batches(str(tmp_path))
    for n, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        sink(spark.createDataFrame(rows[low:high], schema), n)
    got = sorted((r.execution, r.phase, r.at, r.duration_s) for r in spark.read.parquet(f"{tmp_path}/ended").collect())
    assert got == [("a", "TimedOut", at(1800), None), ("b", "Completed", at(4000), 3399), ("c", "Completed", at(700), 600)]


def test_redelivered_records_are_dropped(spark, tmp_path):
    rows = [(1, 0, 5, at(0)), (1, 0, 5, at(0)), (1, 0, 6, at(1)), (2, 0, 5, at(2))]
    schema = "topic int, partition int, offset bigint, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    once = sf_.drop_redelivered(stream, ["topic", "partition", "offset"], "ts", "10 minutes")
    writer = once.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    sf_.run_available(writer, str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


class FakeSession:
    """Just what ``work_dir`` asks a session."""

    def __init__(self, setting, master):
        self.folder = None
        self.master = master
        self.conf = {"spark.checkpoint.dir": setting}
        self.sparkContext = self

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_work_folder_comes_from_the_session():
    from netweir.session import work_dir

    assert work_dir(FakeSession("/shared/folder/", "spark://host"), "x").startswith("/shared/folder/x-")
    with pytest.raises(RuntimeError):
        work_dir(FakeSession(None, "spark://host"), "x")
    local = FakeSession(None, "local[4]")
    assert work_dir(local, "x").startswith(local.folder) and work_dir(local, "y").startswith(local.folder)
