"""Stream and table-writing queries over the test tables.

Each one runs its stream to the end of what has arrived and returns the table it wrote,
so it can be compared with the batch result.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from netweir.functions.timing import micros
from netweir.operators import rollup
from netweir.operators import targets as tg
from netweir.operators.enrich import enrich
from netweir.plans import alert_queries as aq
from netweir.plans import flow_queries as fq
from netweir.plans import inventory_queries as iq
from netweir.plans import metric_queries as mq
from netweir.plans import metric_views as mv
from netweir.plans import runbook_queries as rq
from netweir.plans import views as v
from netweir.plans.registry import SQL, query
from netweir.plans.views_sql import sql
from netweir.session import work_dir
from netweir.sources import store, tables
from netweir.sources.flows import skip_undecoded, to_canonical
from netweir.streaming import alerts as sa
from netweir.streaming import executions as se
from netweir.streaming import flows as sf_
from netweir.streaming import metrics as sm
from netweir.streaming import notices as sn


def table_stream(spark, sf_dir, name):
    """The Parquet file of a test table as a file stream.

    A file of fewer pieces than there are cores is spread; a larger one is left where it is read.
    """
    rows, cores = v.table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.repartition(cores) if rows.rdd.getNumPartitions() < cores else stream


def held(spark, rows, name):
    """Rows that take long to compute, written once and read back."""
    path = work_dir(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def in_arrivals(spark, rows, order, parts, process, ready=False):
    """Land rows in ``parts`` steps of rising ``order`` and let a stream process each arrival.

    ``ready`` rows come straight from a table and are not written aside first.
    """
    landing = work_dir(spark, "landing")
    placed = rows.withColumn("_order", order)
    whole = placed if ready else held(spark, placed, "staged")
    low, high = whole.agg(F.min("_order"), F.max("_order")).first()
    width = (high - low) // parts + 1
    for part in range(parts):
        start = low + part * width
        chosen = whole.where((F.col("_order") >= start) & (F.col("_order") < start + width)).drop("_order")
        chosen.write.mode("append").parquet(landing)
        process(spark.readStream.schema(rows.schema).parquet(landing))


def _foreach(sink, checkpoint):
    return lambda stream: sf_.run_available(stream.writeStream.foreachBatch(sink), checkpoint)


# ------------------------------------------------------------ raw flows


@query("stream_raw_flows", SQL["flow_canonical"])
def stream_raw_flows(spark, sf):
    wire = v.lineitem_wire(table_stream(spark, sf, "lineitem"))
    decoded = wire.select(F.struct(*wire.columns).alias("flow"))
    out = work_dir(spark, "flows")
    writer = to_canonical(skip_undecoded(decoded)).writeStream.format("parquet").option("path", out)
    sf_.run_available(writer, work_dir(spark, "checkpoint"))
    return v.printable(spark.read.parquet(out)).select(*fq.CANONICAL_COLUMNS)


_BY_DAY = sql("""SELECT CAST(ts AS DATE) AS event_date, count(*) AS flow_count, CAST(sum(bytes) AS BIGINT) AS total_bytes,
    max(ts) AS newest FROM v_event_flows GROUP BY ALL""")


def _by_day(table):
    return table.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("flow_count"), F.sum("bytes").alias("total_bytes"),
        F.max("ts").cast("timestamp_ntz").alias("newest"),
    )


@query("stream_flows_raw", _BY_DAY)
def stream_flows_raw(spark, sf):
    out = work_dir(spark, "raw")
    flows = to_canonical(v.event_wire(table_stream(spark, sf, "events")))
    sf_.run_available(sf_.to_raw_table(flows, out), work_dir(spark, "checkpoint"))
    return _by_day(spark.read.parquet(out))


@query("write_flows_raw", _BY_DAY)
def write_flows_raw(spark, sf):
    out = work_dir(spark, "raw")
    tables.write_raw_flows(v.event_flows(spark, sf), out)
    return _by_day(spark.read.parquet(out))


# ------------------------------------------------------------ enrichment


@query("stream_enrich", fq.ENRICHED_SQL)
def stream_enrich(spark, sf):
    flows = to_canonical(v.lineitem_wire(table_stream(spark, sf, "lineitem")))
    out = work_dir(spark, "enriched")
    writer = enrich(flows, v.dimensions(spark, sf)).writeStream.format("parquet").option("path", out)
    sf_.run_available(writer, work_dir(spark, "checkpoint"))
    return v.printable(spark.read.parquet(out).select(*fq.ENRICHED_COLUMNS))


@query("stream_enrich_wide_table", sql(fq.WIDE_SQL))
def stream_enrich_wide_table(spark, sf):
    """Batch by batch, so that a table beyond the packed size is merged with each batch."""
    wire = v.lineitem_wire(table_stream(spark, sf, "lineitem"))
    out = work_dir(spark, "enriched")
    sink = sf_.ranged_batches(fq.wide_table(spark, sf), fq.wide_lookup, out, to_canonical)
    _foreach(sink, work_dir(spark, "checkpoint"))(wire)
    return v.printable(spark.read.parquet(out)).select(
        "ts", "exporter_ip", "in_if", "out_if", "src_ip", "dst_ip", "bytes", "src_country", "src_city", "dst_country", "dst_city"
    )


@query("stream_enrich_refresh", fq.ENRICHED_SQL)
def stream_enrich_refresh(spark, sf):
    """The second refresh fails; the flows of that batch still get the first copy."""
    loads = []

    def loader():
        loads.append(1)
        if len(loads) == 2:
            raise OSError("inventory is not reachable")
        return v.dimensions(spark, sf)

    lookups = sf_.RefreshingDimensions(spark, loader, work_dir(spark, "lookups"), refresh_s=0)
    out, checkpoint = work_dir(spark, "enriched"), work_dir(spark, "checkpoint")
    sink = sf_.enrich_batches(lookups, out)
    flows = v.flows(spark, sf)
    in_arrivals(spark, flows, micros(F.col("ts")), 3, _foreach(sink, checkpoint), ready=True)
    return v.printable(spark.read.parquet(out).select(*fq.ENRICHED_COLUMNS))


# ------------------------------------------------------------ rollups


def _stream_tiers(spark, sf, order, parts=3):
    out, checkpoint = work_dir(spark, "tiers"), work_dir(spark, "checkpoint")
    in_arrivals(spark, v.event_flows(spark, sf), order, parts, _foreach(sf_.write_partials(out), checkpoint))
    return out


_MINUTES, _HOURS = fq.minute_sql("v_event_flows", False), fq.hour_sql("v_event_flows", False)


@query("stream_rollup_1m", _MINUTES)
def stream_rollup_1m(spark, sf):
    out = _stream_tiers(spark, sf, micros(F.col("ts")))
    return v.printable(sf_.read_tier(spark, out, "1m"))


@query("stream_rollup_1h", _HOURS)
def stream_rollup_1h(spark, sf):
    out = _stream_tiers(spark, sf, micros(F.col("ts")))
    return v.printable(sf_.read_tier(spark, out, "1h"))


@query("stream_late_rows", _MINUTES)
def stream_late_rows(spark, sf):
    """Each minute's flows arrive in three batches, days apart: the late ones still count."""
    out = _stream_tiers(spark, sf, F.second("ts"))
    return v.printable(sf_.read_tier(spark, out, "1m"))


@query("stream_rollup_1m_closed", sql(f"""
    SELECT * FROM ({_MINUTES}) WHERE minute + INTERVAL 1 MINUTE <= (
      SELECT max(ts) - INTERVAL 1 HOUR FROM v_event_flows)"""))
def stream_rollup_1m_closed(spark, sf):
    """Append mode: what the watermark has closed by the end of the stream."""
    flows = to_canonical(v.event_wire(table_stream(spark, sf, "events")))
    out = work_dir(spark, "closed")
    writer = sf_.rollup_1m_closed(flows, "1 hour").writeStream.format("parquet").option("path", out)
    sf_.run_available(writer.outputMode("append"), work_dir(spark, "checkpoint"))
    return v.printable(spark.read.parquet(out))


@query("stream_dedup", "SELECT event_id, ts, user_id, value FROM events")
def stream_dedup(spark, sf):
    """Every event is delivered twice; one copy is left."""
    events = table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = events.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    once = sf_.drop_redelivered(twice, ["event_id"], "ts", "1 hour")
    out = work_dir(spark, "once")
    writer = once.writeStream.format("parquet").option("path", out)
    sf_.run_available(writer, work_dir(spark, "checkpoint"))
    return v.printable(spark.read.parquet(out).select("event_id", "ts", "user_id", "value"))


@query("compact_rollup", _MINUTES)
def compact_rollup(spark, sf):
    """Partials of three loads in one table, then merged in place."""
    out = work_dir(spark, "minutes")
    flows = v.event_flows(spark, sf)
    for kind in (1, 6, 17):
        tables.write_minute_tier(rollup.rollup_1m(flows.where(F.col("protocol") == kind)), out)
    tables.compact_rollup(spark, out, rollup.MINUTE_KEYS)
    return v.printable(spark.read.parquet(out).drop("event_date"))


LIFE_END, LIFE_DAYS, LIFE_FROM, LIFE_TO = "2024-01-31 15:30:00", 15, "2024-01-12 00:00:00", "2024-01-20 12:00:00"


@query("stream_store_lifecycle", f"""
    SELECT * FROM ({_MINUTES}) WHERE minute > TIMESTAMP '{LIFE_END}' - INTERVAL {LIFE_DAYS} DAY
        AND minute >= TIMESTAMP '{LIFE_FROM}' AND minute < TIMESTAMP '{LIFE_TO}'""")
def stream_store_lifecycle(spark, sf):
    """A stream fills the minute tier, its batches are compacted, old rows expire, a range is read."""
    out = _stream_tiers(spark, sf, F.second("ts"))
    sf_.compact_tier(spark, out, "1m", fan=2)
    sf_.expire_tier(spark, out, "1m", LIFE_END, LIFE_DAYS)
    store.vacuum(spark, f"{out}/1m", keep=1, grace_s=0)
    return v.printable(sf_.read_tier(spark, out, "1m", LIFE_FROM, LIFE_TO))


@query("stream_store_lifecycle_1h", f"""
    SELECT * FROM ({_HOURS}) WHERE hour > TIMESTAMP '{LIFE_END}' - INTERVAL {LIFE_DAYS} DAY
        AND hour >= TIMESTAMP '{LIFE_FROM}' AND hour < TIMESTAMP '{LIFE_TO}'""")
def stream_store_lifecycle_1h(spark, sf):
    """The same for the hour tier, whose folders are months."""
    out = _stream_tiers(spark, sf, F.second("ts"))
    sf_.compact_tier(spark, out, "1h", fan=2)
    sf_.expire_tier(spark, out, "1h", LIFE_END, LIFE_DAYS)
    store.vacuum(spark, f"{out}/1h", keep=1, grace_s=0)
    return v.printable(sf_.read_tier(spark, out, "1h", LIFE_FROM, LIFE_TO))


@query("stream_compact_replay", _MINUTES)
def stream_compact_replay(spark, sf):
    """Compactions between the batches of a stream, and batches that come once more after them."""
    out, landing = work_dir(spark, "tiers"), work_dir(spark, "landing")
    flows = v.event_flows(spark, sf).withColumn("_part", F.second("ts") % 5)
    flows.write.partitionBy("_part").parquet(landing)
    sink = sf_.write_partials(out, raw=False)
    arrived = spark.read.parquet(landing)
    for batch_id, again in ((0, []), (1, [0]), (2, []), (3, [1, 2]), (4, [4, 0])):
        sink(arrived.where(F.col("_part") == batch_id).drop("_part"), batch_id)
        if batch_id in (1, 3):
            sf_.compact_tier(spark, out, "1m", fan=2)
        for replayed in again:
            sink(arrived.where(F.col("_part") == replayed).drop("_part"), replayed)
    return v.printable(sf_.read_tier(spark, out, "1m"))


@query("expire_raw", sql("""
    SELECT ts, exporter_ip, bytes FROM v_event_flows WHERE ts > TIMESTAMP '2024-01-31 15:30:00' - INTERVAL 7 DAY"""))
def expire_raw(spark, sf):
    out = work_dir(spark, "raw")
    tables.write_raw_flows(v.event_flows(spark, sf), out)
    tables.expire(spark, out, "ts", "2024-01-31 15:30:00", rollup.RETENTION_DAYS["raw"])
    return v.printable(spark.read.parquet(out).select("ts", "exporter_ip", "bytes"))


@query("write_hour_tier", sql(f"""
    SELECT strftime(hour, '%Y%m') AS event_month, count(*) AS rows, CAST(sum(bytes_sum) AS BIGINT) AS total_bytes
    FROM ({_HOURS}) GROUP BY ALL"""))
def write_hour_tier(spark, sf):
    out = work_dir(spark, "hours")
    tables.write_hour_tier(rollup.rollup_1h(v.event_flows(spark, sf)), out)
    months = spark.read.parquet(out).groupBy(F.col("event_month").cast("string").alias("event_month"))
    return months.agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes_sum").alias("total_bytes"))


# ------------------------------------------------------------ targets


@query("write_targets", sql("SELECT probe, target, labels FROM v_probe"))
def write_targets(spark, sf):
    out = work_dir(spark, "targets")
    tables.write_targets(tg.probe_targets(iq.inventory(spark, sf)), out)
    schema = "targets ARRAY<STRING>, labels MAP<STRING, STRING>, probe STRING"
    return iq._flat(spark.read.schema(schema).json(out)).select("probe", "target", "labels")


@query("guarded_overwrite", sql("SELECT target, labels FROM v_snmp"))
def guarded_overwrite(spark, sf):
    """A full target list, then an empty one that must not replace it."""
    out = work_dir(spark, "guarded")
    listed = tg.snmp_targets(iq.inventory(spark, sf))
    tables.guarded_overwrite(listed, out)
    tables.guarded_overwrite(listed.where(F.size("targets") == 0), out)
    return iq._flat(spark.read.parquet(out))


# ------------------------------------------------------------ alerts, notifications, executions

LATE_STEPS = 3  # how late a step may come
CLOCK_STEPS = 1000  # how long after the last step the clock of a test stream goes on


@query("stream_alerts", SQL["alert_high_memory"])
def stream_alerts(spark, sf):
    found = None
    for name in ("HighMemory", "HighMemoryUtilization"):
        out, checkpoint = work_dir(spark, "alerts"), work_dir(spark, "checkpoint")
        sink = sa.evaluate_batches(aq.RULES[name], aq.STEP, out)
        in_arrivals(spark, aq.CONDITIONS[name](spark, sf), micros(F.col("t")), 3, _foreach(sink, checkpoint))
        states = sa.read_states(spark, out).drop("just_fired")
        found = states if found is None else found.unionByName(states)
    return found


@query("stream_notifications", aq.SCHEDULE_SQL)
def stream_notifications(spark, sf):
    steps = sa.group_steps(aq.schedule_inputs(spark, sf), aq.al.GROUP_BY, aq.STEP)
    out, checkpoint = work_dir(spark, "notified"), work_dir(spark, "checkpoint")

    def process(stream):
        sent = sa.notify_stream(stream, aq.al.GROUP_BY, aq.STEP, aq.WAIT, aq.EVERY)
        sf_.run_available(sent.writeStream.format("parquet").option("path", out), checkpoint)

    in_arrivals(spark, steps, F.col("k"), 3, process)
    return spark.read.parquet(out)


@contextmanager
def keyed_states(spark):
    """The state store that keyed state machines need, for the streams started within."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, sn.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _clock(rows, columns, time, later):
    """A row of nobody's, so long after the last one that all timers have run."""
    end = rows.agg((F.max(time) + later).alias(time))
    named = {c: F.lit(v).cast(dict(rows.dtypes)[c]) for c, v in columns.items()}
    return end.select(*[F.col(time) if c == time else named.get(c, F.lit(None).cast(kind)).alias(c) for c, kind in rows.dtypes])


@query("stream_notifications_resolved", aq.RESOLVED_SQL)
def stream_notifications_resolved(spark, sf):
    """Steps arrive in batches that are not in the order of time within the allowed lateness."""
    steps = sa.group_steps(aq.schedule_inputs(spark, sf), aq.al.GROUP_BY, aq.STEP)
    out, checkpoint = work_dir(spark, "notified"), work_dir(spark, "checkpoint")
    steps = held(spark, steps.withColumn("order", F.col("k") + F.pmod(F.xxhash64("device", "k"), F.lit(LATE_STEPS))), "steps")
    end = _clock(steps, dict.fromkeys(aq.al.GROUP_BY, "") | {"changed": 0, "repeat_s": 1}, "k", CLOCK_STEPS).withColumn("order", F.col("k"))

    def process(stream):
        rows = stream.drop("order")
        sent = sn.notice_stream(rows, aq.al.GROUP_BY, aq.STEP, aq.WAIT, aq.EVERY, LATE_STEPS * aq.STEP)
        sf_.run_available(sent.writeStream.format("parquet").option("path", out), checkpoint)

    with keyed_states(spark):
        in_arrivals(spark, steps.unionByName(end), F.col("order"), 3, process, ready=True)
    return spark.read.parquet(out).where("alertname != ''")


@query("stream_alert_intervals", SQL["alert_intervals"])
def stream_alert_intervals(spark, sf):
    """Active steps of all rules in one stream, some of them late, to closed intervals."""
    active = aq.tagged(spark, sf, aq.OVERVIEW)
    late = F.pmod(F.xxhash64("series_key", "t"), F.lit(LATE_STEPS)) * aq.STEP
    arrival = (F.unix_micros(F.col("t").cast("timestamp")) + late * 1_000_000).cast("long")
    active = active.select("alertname", "severity", "need", "series_key", F.col("t").cast("timestamp").alias("t"), arrival.alias("order"))
    active = held(spark, active, "active")
    end = _clock(active, {"alertname": "", "severity": "", "need": 0, "series_key": ""}, "order", CLOCK_STEPS * aq.STEP * 1_000_000)
    end = end.withColumn("t", F.timestamp_micros("order"))
    out, checkpoint = work_dir(spark, "intervals"), work_dir(spark, "checkpoint")

    def process(stream):
        closed = sa.interval_stream(stream, aq.STEP, LATE_STEPS * aq.STEP)
        sf_.run_available(closed.writeStream.format("parquet").option("path", out), checkpoint)

    in_arrivals(spark, active.unionByName(end), F.col("order"), 3, process, ready=True)
    return spark.read.parquet(out).where("alertname != ''")


@query("stream_counter_rate", SQL["counter_rate"])
def stream_counter_rate(spark, sf):
    """Samples of one counter, some of them late, to rates at every grid point."""
    samples = mv.samples(spark, sf, "ifHCInOctets").select("series_key", F.col("ts").cast("timestamp").alias("ts"), "value")
    late_s = LATE_STEPS * mv.STEP
    order = micros(F.col("ts")) + F.pmod(F.xxhash64("series_key", "ts"), F.lit(LATE_STEPS)) * mv.STEP * 1_000_000
    samples = held(spark, samples.withColumn("order", order), "samples")
    end = _clock(samples, {"series_key": "", "value": 0.0}, "order", CLOCK_STEPS * mv.STEP * 1_000_000)
    end = end.withColumn("ts", F.timestamp_micros("order"))
    out, checkpoint = work_dir(spark, "rates"), work_dir(spark, "checkpoint")

    def process(stream):
        rates = sm.rate_stream(stream.drop("order"), mq.RANGE, mv.STEP, late_s)
        sf_.run_available(rates.writeStream.format("parquet").option("path", out), checkpoint)

    in_arrivals(spark, samples.unionByName(end), F.col("order"), 3, process, ready=True)
    return spark.read.parquet(out).where("series_key != ''")


@query("stream_executions", sql("""
    WITH e AS (SELECT *, CASE WHEN phase = 'PendingApproval' THEN created_at
        ELSE created_at + to_seconds(duration_s) + INTERVAL 250 MILLISECOND END AS ts FROM v_exec)
    SELECT execution, 'TimedOut' AS phase, ts + to_seconds(timeout_s) AS at, NULL AS duration_s FROM e
    WHERE phase = 'PendingApproval' AND ts + to_seconds(timeout_s) < (SELECT max(ts) FROM e)
    UNION ALL SELECT execution, phase, ts, duration_s FROM e WHERE phase != 'PendingApproval'"""))
def stream_executions(spark, sf):
    events = rq.executions(spark, sf).select(
        "execution", "phase", F.coalesce("completion_time", "created_at").alias("ts"), "start_time", "approval_timeout"
    )
    out, checkpoint = work_dir(spark, "executions"), work_dir(spark, "checkpoint")
    in_arrivals(spark, events, micros(F.col("ts")), 3, _foreach(se.track_batches(out), checkpoint))
    return spark.read.parquet(f"{out}/ended").drop("batch_id")
