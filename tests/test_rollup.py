"""Invariants of the tiers, and the tables they are written to."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from netweir.operators import rollup
from netweir.operators.enrich import enrich
from netweir.plans import views as v
from netweir.schema import HOUR_KEYS, MINUTE_KEYS
from netweir.sources import tables


@pytest.fixture(scope="module")
def flows(spark, sf_dir):
    # Few talkers in few minutes, so that rows do merge.
    events = v.event_flows(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts") + F.expr("INTERVAL 7 SECONDS"))
    return events.withColumn("src_ip", F.col("dst_ip")).withColumn("in_if_name", F.lit("e")).cache()


def totals(df, names=("bytes_sum", "packets_sum", "flow_count")):
    return tuple(df.agg(*[F.sum(n) for n in names]).first())


def test_sums_agree_across_tiers(flows):
    raw = tuple(flows.agg(F.sum("bytes"), F.sum("packets"), F.count("*")).first())
    minutes, hours = rollup.rollup_1m(flows), rollup.rollup_1h(flows)
    assert totals(minutes) == totals(hours) == totals(rollup.minute_to_hour(minutes)) == raw
    assert minutes.count() < flows.count()


def test_partials_of_any_split_merge_to_the_whole(flows):
    parts = None
    for i in range(4):
        part = rollup.rollup_1m(flows.where(F.pmod(F.hash("bytes"), F.lit(4)) == i))
        parts = part if parts is None else parts.unionByName(part)
    merged = rollup.merge_partials(parts, MINUTE_KEYS)
    whole = rollup.rollup_1m(flows)
    assert merged.exceptAll(whole).count() == whole.exceptAll(merged).count() == 0


def test_hours_from_minutes_equal_hours_from_raw(flows):
    direct, stepped = rollup.rollup_1h(flows), rollup.minute_to_hour(rollup.rollup_1m(flows))
    assert direct.select(*HOUR_KEYS, "bytes_sum").exceptAll(stepped.select(*HOUR_KEYS, "bytes_sum")).count() == 0


def test_tier_choice():
    assert rollup.pick_tier(3600, {"src_ip", "bytes"}) == "raw"
    assert rollup.pick_tier(86_400, {"src_ip", "bytes"}) == "1m"
    assert rollup.pick_tier(30 * 86_400, {"protocol", "bytes"}) == "1h"
    assert rollup.pick_tier(86_400, {"tcp_flags"}) == "raw"
    with pytest.raises(ValueError):
        rollup.pick_tier(30 * 86_400, {"tcp_flags"})


def test_raw_table_layout_and_pruning(spark, sf_dir, tmp_path):
    from netweir.operators.panels import time_range

    path = str(tmp_path / "raw")
    flows = v.event_flows(spark, sf_dir)
    tables.write_raw_flows(flows, path, files=4)
    table = spark.read.parquet(path)
    assert table.count() == flows.count()
    day = time_range(table, "2024-01-05 00:00:00", "2024-01-05 23:59:59").groupBy("src_ip").agg(F.sum("bytes"))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp,src_ip:binary,bytes:bigint>" in plan


def test_expire_drops_days_and_trims_the_boundary(spark, sf_dir, tmp_path):
    path = str(tmp_path / "raw")
    flows = v.event_flows(spark, sf_dir)
    tables.write_raw_flows(flows, path)
    as_of = "2024-01-20 12:00:00"
    dropped = tables.expire(spark, path, "ts", as_of, 7)
    assert "2024-01-12" in dropped and "2024-01-13" not in dropped
    left = spark.read.parquet(path)
    want = flows.where(F.col("ts") > F.lit(dt.datetime(2024, 1, 13, 12)))
    assert left.count() == want.count() and left.agg(F.min("ts")).first() == want.agg(F.min("ts")).first()


def test_compaction_keeps_content(spark, flows, tmp_path):
    path = str(tmp_path / "minutes")
    for kind in (1, 6, 17):
        tables.write_minute_tier(rollup.rollup_1m(flows.where(F.col("protocol") == kind)), path)
        tables.write_minute_tier(rollup.rollup_1m(flows.where(F.col("protocol") == kind)), path)
    before = spark.read.parquet(path)
    rows, sums = before.count(), totals(before)
    tables.compact_rollup(spark, path, MINUTE_KEYS)
    after = spark.read.parquet(path)
    assert after.count() * 2 == rows and totals(after) == sums


def test_samples_round_trip(spark, sf_dir, tmp_path):
    from netweir.plans import metric_views as mv

    path = str(tmp_path / "samples")
    samples = mv.samples(spark, sf_dir, "up", "bgpPeerState")
    tables.write_samples(samples, path)
    back = tables.read_samples(spark, path)
    assert back.where("metric = 'up'").count() == samples.count() // 2
    plan = back.where("metric = 'up'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric" in plan


def test_prefix_source(spark, tmp_path):
    csv = tmp_path / "geo.csv"
    csv.write_text("network,plen,country,city\n" + "00" * 10 + "FFFF08000000,104,US,Ashburn\n")
    row = tables.read_prefixes(spark, str(csv), "country STRING, city STRING").first()
    assert (bytes(row.prefix)[-4:], row.plen, row.country) == (bytes([8, 0, 0, 0]), 104, "US")
    assert tables.read_prefixes(spark, str(tmp_path / "none.csv"), "country STRING") is None


def test_audit_source(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"timestamp":"2024-01-01T00:00:00Z","eventType":"StepFailed","details":{"k":"v"}}\n')
    row = tables.read_audit(spark, str(tmp_path)).first()
    assert row.eventType == "StepFailed" and row.details == {"k": "v"} and row.timestamp is not None


class StubbornFiles:
    """A file system whose renames fail after the first ``good`` ones."""

    def __init__(self, fs, good):
        self.fs, self.left = fs, good

    def __getattr__(self, name):
        return getattr(self.fs, name)

    def rename(self, source, target):
        self.left -= 1
        return self.fs.rename(source, target) if self.left >= 0 else False


@pytest.mark.parametrize("good", [0, 1])
def test_a_failed_rename_does_not_lose_the_table(spark, tmp_path, monkeypatch, good):
    path = str(tmp_path / "t")
    tables.guarded_overwrite(spark.range(3), path)
    real, files = tables._fs, {}

    def stubborn(session, name):
        fs, jpath = real(session, name)
        return files.setdefault("fs", StubbornFiles(fs, good)), jpath

    # The second failing rename is the one back; it is allowed to work.
    monkeypatch.setattr(tables, "_fs", stubborn)
    original = StubbornFiles.rename
    monkeypatch.setattr(StubbornFiles, "rename", lambda self, a, b: self.fs.rename(a, b) if str(a.getName()).endswith(".previous") else original(self, a, b))
    with pytest.raises(OSError):
        tables.guarded_overwrite(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3


def test_month_tables_expire_and_compact(spark, flows, tmp_path):
    path = str(tmp_path / "hours")
    hours = rollup.rollup_1h(flows)
    for _ in range(2):
        tables.write_hour_tier(hours, path)
    tables.compact_rollup(spark, path, HOUR_KEYS, period="event_month")
    table = spark.read.parquet(path)
    assert table.count() == hours.count()
    months = sorted(r[0] for r in hours.select(F.date_format("hour", "yyyyMM")).distinct().collect())
    as_of, days = hours.agg(F.max("hour")).first()[0], 10
    tables.expire(spark, path, "hour", str(as_of), days, "event_month")
    left = spark.read.parquet(path)
    assert left.count() == hours.where(F.col("hour") > F.lit(as_of - dt.timedelta(days=days))).count()
    assert months[-1] in {str(r[0]) for r in left.select("event_month").distinct().collect()}


@pytest.mark.parametrize("rolled", [rollup.rollup_1m, rollup.rollup_1h])
def test_rollups_with_interfaces_too_many_to_send(spark, sf_dir, rolled):
    """The aggregation is the only move of the flows."""
    flows = v.flows(spark, sf_dir)
    small, large = v.dimensions(spark, sf_dir), v.dimensions(spark, sf_dir)
    large.sizes["interface"] = False
    out = rolled(enrich(flows, large))
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert len(joins) > 5 and all("broadcast" in line for line in joins)
    key = lambda r: tuple(map(str, r))
    assert sorted(out.collect(), key=key) == sorted(rolled(enrich(flows, small)).collect(), key=key)
