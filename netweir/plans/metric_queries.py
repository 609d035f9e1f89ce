"""Metric queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweir.functions.labels import any_of, copy_label, label, rename_metric, series_key
from netweir.functions.timing import bucket_start, ntz
from netweir.operators import vectors as m
from netweir.operators.rollup import retained
from netweir.plans import metric_views as mv
from netweir.plans import views as v
from netweir.plans.metric_views import DAY, STEP
from netweir.plans.registry import query
from netweir.plans.views_sql import sql
from netweir.schema import METRIC_RETENTION_DAYS

RANGE = 2 * DAY
PULL = "job IN ('snmp', 'gnmic')"
AT = "2024-01-20 12:00:00"


def _plain(samples):
    return samples.select("series_key", ntz(F.col("ts")).alias("ts"), "value")


# ------------------------------------------------------------ matchers and filters


@query("match_eq", sql("""
    SELECT series_key, ts, value FROM v_m_probe_icmp_duration_seconds WHERE phase = 'rtt'"""))
def match_eq(spark, sf):
    metric = "probe_icmp_duration_seconds"
    return _plain(m.select_series(mv.samples(spark, sf, metric), metric, equal={"phase": "rtt"}))


@query("match_regex", sql(f"""
    SELECT series_key, ts, value FROM v_m_up WHERE {PULL} AND site IN ('site1', 'site2')"""))
def match_regex(spark, sf):
    matchers = {"job": "snmp|gnmic", "site": any_of(["site1", "site2"]), "instance": any_of(None)}
    return _plain(m.select_series(mv.samples(spark, sf, "up"), "up", regex=matchers))


@query("value_filter", sql("""
    SELECT series_key, ts, value FROM v_m_device_cpu_utilization WHERE value > 80"""))
def value_filter(spark, sf):
    metric = "device_cpu_utilization"
    return _plain(m.keep_where(mv.samples(spark, sf, metric), lambda x: x > 80))


@query("label_values", sql(f"""
    SELECT DISTINCT 'site' AS label, site AS label_value FROM v_m_up WHERE {PULL}
    UNION ALL SELECT DISTINCT 'instance', instance FROM v_m_up WHERE {PULL} AND site IN ('site3', 'site5')
    UNION ALL SELECT DISTINCT 'ifName', ifName FROM v_m_ifHCInOctets"""))
def label_values(spark, sf):
    up = m.select_series(mv.samples(spark, sf, "up"), "up", regex={"job": "snmp|gnmic"})
    chosen = m.select_series(up, "up", regex={"site": any_of(["site3", "site5"])})
    parts = [(up, "site"), (chosen, "instance"), (mv.samples(spark, sf, "ifHCInOctets"), "ifName")]
    result = None
    for samples, name in parts:
        part = m.label_values(samples, name).select(F.lit(name).alias("label"), F.col(name).alias("label_value"))
        result = part if result is None else result.unionByName(part)
    return result


@query("relabel", sql(f"""
    SELECT 'device_interfaces_' || m AS metric,
        concat('{{"device":"', instance, '","instance":"', instance, '","source":"', instance, '"}}') AS series_key,
        count(*) AS sample_count, sum(cents) // 1 AS total
    FROM (SELECT *, unnest(['in', 'out']) AS m FROM v_scrape_base) GROUP BY ALL""".replace(
        "sum(cents) // 1", "CAST(sum(cents) AS BIGINT)")))
def relabel(spark, sf):
    names = F.explode(F.array(F.lit("gnmic_interfaces_in"), F.lit("gnmic_interfaces_out"))).alias("metric")
    rows = mv.scrapes(spark, sf).select(
        names, F.create_map(F.lit("source"), F.col("instance")).alias("labels"), "cents"
    )
    labels = copy_label(copy_label(F.col("labels"), "source", "device"), "device", "instance")
    return (
        rows.withColumn("metric", rename_metric(F.col("metric"), "^gnmic_(.*)$", "device_$1"))
        .withColumn("series_key", series_key(labels))
        .groupBy("metric", "series_key")
        .agg(F.count(F.lit(1)).alias("sample_count"), F.sum("cents").alias("total"))
    )


# ------------------------------------------------------------ gauges on the grid


def _gauge(name, metric, where="true", equal=None, regex=None):
    source = f"(SELECT * FROM v_m_{metric} WHERE {where})"
    text = mv.grid_sql(source, "arg_max(value, ts)", DAY, STEP, include_end=True)

    @query(name, sql(text))
    def run(spark, sf):
        picked = m.select_series(mv.samples(spark, sf, metric), metric, equal, regex)
        return m.on_grid(picked, STEP, DAY)


_gauge("gauge_cpu", "device_cpu_utilization")
_gauge("gauge_memory", "device_memory_utilization")
_gauge("gauge_temperature", "device_temperature_celsius")
_gauge("psu_status", "device_power_supply_status")
_gauge("bgp_neighbor_state", "bgpPeerState")
_gauge("bgp_session_uptime", "bgpPeerFsmEstablishedTime")
_gauge("probe_latency", "probe_icmp_duration_seconds", "phase = 'rtt'", equal={"phase": "rtt"})
_gauge("probe_tcp_time", "probe_duration_seconds", "module = 'tcp_connect'", equal={"module": "tcp_connect"})
_gauge("probe_http_time", "probe_http_duration_seconds")


@query("bgp_prefixes", sql(f"""
    SELECT 'received' AS direction, * FROM ({mv.latest_sql('bgpPeerPrefixesReceived', DAY, STEP)})
    UNION ALL SELECT 'sent', * FROM ({mv.latest_sql('bgpPeerPrefixesSent', DAY, STEP)})"""))
def bgp_prefixes(spark, sf):
    samples = mv.samples(spark, sf, "bgpPeerPrefixesReceived", "bgpPeerPrefixesSent")
    direction = F.when(F.col("metric") == "bgpPeerPrefixesReceived", "received").otherwise("sent")
    both = m.on_grid(samples, STEP, DAY, ["metric", "series_key"])
    return both.select(direction.alias("direction"), "series_key", "t", "value")


@query("uptime_seconds", sql(f"""
    SELECT series_key, t, value / 100 AS value FROM ({mv.latest_sql('sysUpTime', DAY, STEP)})"""))
def uptime_seconds(spark, sf):
    return m.scale(m.on_grid(mv.samples(spark, sf, "sysUpTime"), STEP, DAY), lambda x: x / 100)


@query("instant_vector", sql(f"""
    SELECT series_key, TIMESTAMP '{AT}' AS t, arg_max(value, ts) AS value FROM v_m_bgpPeerState
    WHERE ts <= TIMESTAMP '{AT}' AND ts > TIMESTAMP '{AT}' - INTERVAL 2 DAY GROUP BY series_key"""))
def instant_vector(spark, sf):
    return m.instant(mv.samples(spark, sf, "bgpPeerState"), AT, 2 * DAY)


@query("threshold_bands", sql(f"""
    SELECT 'cpu' AS panel, CASE WHEN value >= 80 THEN 'red' WHEN value >= 60 THEN 'yellow' ELSE 'green' END AS band,
        count(*) AS points FROM ({mv.latest_sql('device_cpu_utilization', DAY, STEP)}) GROUP BY ALL
    UNION ALL SELECT 'memory', CASE WHEN value >= 85 THEN 'red' WHEN value >= 70 THEN 'yellow' ELSE 'green' END,
        count(*) FROM ({mv.latest_sql('device_memory_utilization', DAY, STEP)}) GROUP BY ALL
    UNION ALL SELECT 'temperature', CASE WHEN value >= 70 THEN 'red' WHEN value >= 50 THEN 'yellow' ELSE 'green' END,
        count(*) FROM ({mv.latest_sql('device_temperature_celsius', DAY, STEP)}) GROUP BY ALL"""))
def threshold_bands(spark, sf):
    panels = {
        "cpu": ("device_cpu_utilization", 60, 80),
        "memory": ("device_memory_utilization", 70, 85),
        "temperature": ("device_temperature_celsius", 50, 70),
    }
    samples = mv.samples(spark, sf, *[metric for metric, _, _ in panels.values()])
    panel = named = None
    for name, (metric, warn, high) in panels.items():
        hit = F.col("metric") == metric
        bands = m.band(F.col("value"), [(warn, "yellow"), (high, "red")], "green")
        panel = F.when(hit, name) if panel is None else panel.when(hit, name)
        named = F.when(hit, bands) if named is None else named.when(hit, bands)
    vector = m.on_grid(samples, STEP, DAY, ["metric", "series_key"])
    return vector.groupBy(panel.alias("panel"), named.alias("band")).agg(F.count(F.lit(1)).alias("points"))


# ------------------------------------------------------------ rates


def rates_of(spark, sf, *metrics):
    """Rates of several metrics in one pass."""
    return m.rate(mv.samples(spark, sf, *metrics), RANGE, STEP, ["metric", "series_key"])


def matched(spark, sf, *metrics):
    """Rates of metrics that share their labels, one column each."""
    return m.side_by_side(rates_of(spark, sf, *metrics), list(metrics))


@query("counter_rate", sql(mv.rate_sql("ifHCInOctets", RANGE, STEP)))
def counter_rate(spark, sf):
    return m.rate(mv.samples(spark, sf, "ifHCInOctets"), RANGE, STEP)


@query("iface_bps_in_out", sql(f"""
    SELECT 'in' AS direction, series_key, t, value * 8 AS value FROM ({mv.rate_sql('ifHCInOctets', RANGE, STEP)})
    UNION ALL SELECT 'out', series_key, t, value * 8 * -1 FROM ({mv.rate_sql('ifHCOutOctets', RANGE, STEP)})"""))
def iface_bps_in_out(spark, sf):
    both = rates_of(spark, sf, "ifHCInOctets", "ifHCOutOctets")
    inbound = F.col("metric") == "ifHCInOctets"
    return both.select(
        F.when(inbound, "in").otherwise("out").alias("direction"), "series_key", "t",
        F.when(inbound, F.col("value") * 8).otherwise(F.col("value") * 8 * -1).alias("value"),
    )


_ERROR_METRICS = ["ifInErrors", "ifOutErrors", "ifInDiscards", "ifOutDiscards"]


@query("iface_error_rates", sql(" UNION ALL ".join(
    f"SELECT '{name}' AS metric, * FROM ({mv.rate_sql(name, RANGE, STEP)})" for name in _ERROR_METRICS)))
def iface_error_rates(spark, sf):
    return rates_of(spark, sf, *_ERROR_METRICS)


@query("bgp_flaps", sql(mv.increase_sql("bgpPeerFsmEstablishedTransitions", DAY, STEP)))
def bgp_flaps(spark, sf):
    return m.increase(mv.samples(spark, sf, "bgpPeerFsmEstablishedTransitions"), DAY, STEP)


@query("sync_errors_increase", sql(mv.increase_sql("target_sync_errors_total", RANGE, STEP)))
def sync_errors_increase(spark, sf):
    return m.increase(mv.samples(spark, sf, "target_sync_errors_total"), RANGE, STEP)


@query("increase_fine_grid", sql(mv.increase_sql("ifHCInOctets", 3 * DAY, 3600)))
def increase_fine_grid(spark, sf):
    """A range much longer than the step: 72 panes per window."""
    return m.increase(mv.samples(spark, sf, "ifHCInOctets"), 3 * DAY, 3600)


@query("packet_loss_pct", sql(f"""
    SELECT series_key, t, (1 - value) * 100 AS value FROM (
    {mv.grid_sql("(SELECT * FROM v_m_probe_success WHERE module = 'icmp')", "sum(value) / count(*)", DAY, STEP)})"""))
def packet_loss_pct(spark, sf):
    icmp = m.select_series(mv.samples(spark, sf, "probe_success"), "probe_success", equal={"module": "icmp"})
    return m.scale(m.avg_over_time(icmp, DAY, STEP), lambda x: (1 - x) * 100)


# ------------------------------------------------------------ vector matching


@query("iface_utilization", sql(f"""
    SELECT series_key, t, r.value * 8 / nullif(s.value, 0) / 1000000.0E0 * 100 AS value
    FROM ({mv.rate_sql('ifHCInOctets', RANGE, STEP)}) r
    JOIN ({mv.latest_sql('ifHighSpeed', RANGE, STEP)}) s USING (series_key, t) WHERE s.value != 0"""))
def iface_utilization(spark, sf):
    bits = m.scale(m.rate(mv.samples(spark, sf, "ifHCInOctets"), RANGE, STEP), lambda x: x * 8)
    speed = m.on_grid(mv.samples(spark, sf, "ifHighSpeed"), STEP, RANGE)
    return m.scale(m.combine(bits, speed, m.ratio), lambda x: x / F.lit(1e6) * 100)


@query("iface_error_ratio", sql(f"""
    SELECT series_key, t, e.value / nullif(p.value, 0) AS value
    FROM ({mv.rate_sql('interface_errors_total', RANGE, STEP)}) e
    JOIN ({mv.rate_sql('interface_packets_total', RANGE, STEP)}) p USING (series_key, t) WHERE p.value != 0"""))
def iface_error_ratio(spark, sf):
    both = matched(spark, sf, "interface_errors_total", "interface_packets_total")
    return both.select(
        "series_key", "t", m.ratio(F.col("interface_errors_total"), F.col("interface_packets_total")).alias("value")
    ).where(F.col("value").isNotNull())


def error_share_sql(side, limit):
    return f"""SELECT series_key, t, e.value / (o.value + 1) AS value
        FROM ({mv.rate_sql(f'if{side}Errors', RANGE, STEP)}) e
        JOIN ({mv.rate_sql(f'if{side}Octets', RANGE, STEP)}) o USING (series_key, t)
        WHERE e.value / (o.value + 1) > {limit}"""


SHARE_LIMIT = 0.01
ERROR_SHARE_SQL = f"""
    WITH l AS ({error_share_sql('In', SHARE_LIMIT)}), r AS ({error_share_sql('Out', SHARE_LIMIT)})
    SELECT * FROM l UNION ALL SELECT * FROM r WHERE NOT EXISTS
      (SELECT 1 FROM l WHERE l.series_key = r.series_key AND l.t = r.t)"""


def _share(side):
    return m.ratio(F.col(f"if{side}Errors"), F.col(f"if{side}Octets") + 1)


@query("vector_or", sql(ERROR_SHARE_SQL))
def vector_or(spark, sf):
    """rate(errors) / (rate(octets) + 1) above the limit: inbound series, or else outbound ones."""
    sides = []
    for side in ("In", "Out"):
        rates = matched(spark, sf, f"if{side}Errors", f"if{side}Octets")
        share = rates.select("series_key", "t", _share(side).alias("value"))
        sides.append(m.keep_where(share, lambda x: x > SHARE_LIMIT))
    return m.either(*sides)


def error_share(spark, sf):
    """The same vector in one pass: both sides of a series stand in one row."""
    rates = matched(spark, sf, "ifInErrors", "ifInOctets", "ifOutErrors", "ifOutOctets")
    inbound, outbound = _share("In"), _share("Out")
    value = F.coalesce(
        F.when(inbound > SHARE_LIMIT, inbound), F.when(outbound > SHARE_LIMIT, outbound)
    )
    return rates.select("series_key", "t", value.alias("value")).where(F.col("value").isNotNull())


@query("iface_correlation", sql(f"""
    WITH c AS (SELECT {mv.label_sql('instance')} AS device, {mv.label_sql('ifName')} AS interface_name, t,
        value * 8 AS counter_bps FROM ({mv.rate_sql('ifHCInOctets', RANGE, STEP)})),
    f AS (SELECT 'r' || (exporter_ip - 167772160) AS device, 'eth' || (in_if - 1) AS interface_name,
        time_bucket(INTERVAL '6 hours', ts) + INTERVAL 6 HOUR AS t,
        CAST(sum(bytes) * 8 AS DOUBLE) / {STEP} AS flow_bps FROM v_event_flows GROUP BY ALL)
    SELECT device, interface_name, t, counter_bps, flow_bps FROM c FULL JOIN f USING (device, interface_name, t)"""))
def iface_correlation(spark, sf):
    counters = m.rate(mv.samples(spark, sf, "ifHCInOctets"), RANGE, STEP).select(
        label(F.col("series_key"), "instance").alias("device"),
        label(F.col("series_key"), "ifName").alias("interface_name"),
        "t",
        (F.col("value") * 8).alias("counter_bps"),
    )
    flows = (
        v.event_flows(spark, sf)
        .select(
            F.concat(F.lit("r"), (F.col("exporter_ip") - v.NET10).cast("string")).alias("device"),
            F.concat(F.lit("eth"), (F.col("in_if") - 1).cast("string")).alias("interface_name"),
            ntz(bucket_start(F.col("ts"), STEP) + F.expr(f"INTERVAL {STEP} SECONDS")).alias("t"),
            "bytes",
        )
        .groupBy("device", "interface_name", "t")
        .agg((F.sum("bytes") * 8 / F.lit(STEP)).alias("flow_bps"))
    )
    return counters.join(flows, ["device", "interface_name", "t"], "full")


# ------------------------------------------------------------ aggregation over series

_UP = f"(SELECT * FROM v_m_up WHERE {PULL})"
_UP_SQL = mv.grid_sql(_UP, "arg_max(value, ts)", DAY, STEP, include_end=True)


def pulled_up(spark, sf):
    """Reachability of the devices that are polled, on the grid."""
    return m.on_grid(m.select_series(mv.samples(spark, sf, "up"), "up", regex={"job": "snmp|gnmic"}), STEP, DAY)


@query("count_devices", sql(f"SELECT t, count(*) AS value FROM ({_UP_SQL}) GROUP BY t"))
def count_devices(spark, sf):
    return m.aggregate(pulled_up(spark, sf), "count")


@query("devices_up", sql(f"SELECT t, count(*) AS value FROM ({_UP_SQL}) WHERE value = 1 GROUP BY t"))
def devices_up(spark, sf):
    return m.aggregate(m.keep_where(pulled_up(spark, sf), lambda x: x == 1), "count")


@query("devices_down_or_zero", sql(f"""
    SELECT t, CAST(count(*) FILTER (value = 0) AS DOUBLE) AS value FROM ({_UP_SQL}) GROUP BY t"""))
def devices_down_or_zero(spark, sf):
    up = pulled_up(spark, sf)
    return m.count_or_zero(up, lambda x: x == 0)


@query("devices_per_site", sql(f"""
    SELECT t, {mv.label_sql('site')} AS site, count(*) AS value FROM ({_UP_SQL}) GROUP BY ALL"""))
def devices_per_site(spark, sf):
    return m.aggregate(pulled_up(spark, sf), "count", ["site"])


@query("bgp_established", sql(f"""
    SELECT t, count(*) AS value FROM ({mv.latest_sql('bgpPeerState', DAY, STEP)}) WHERE value = 6 GROUP BY t"""))
def bgp_established(spark, sf):
    state = m.on_grid(mv.samples(spark, sf, "bgpPeerState"), STEP, DAY)
    return m.aggregate(m.keep_where(state, lambda x: x == 6), "count")


@query("bgp_state_counts", sql(f"""
    SELECT t, CAST(value AS BIGINT) AS state, count(*) AS sessions FROM ({mv.latest_sql('bgpPeerState', DAY, STEP)})
    GROUP BY ALL"""))
def bgp_state_counts(spark, sf):
    state = m.on_grid(mv.samples(spark, sf, "bgpPeerState"), STEP, DAY)
    return state.groupBy("t", F.col("value").cast("long").alias("state")).agg(F.count(F.lit(1)).alias("sessions"))


def _per_second(vector, factor=8):
    """Summed counter growth to a rate. Growth is summed first: that sum is exact."""
    return m.scale(vector, lambda x: x / F.lit(float(RANGE)) * factor)


_IN, _OUT = mv.increase_sql("ifHCInOctets", RANGE, STEP), mv.increase_sql("ifHCOutOctets", RANGE, STEP)


@query("site_bandwidth", sql(f"""
    SELECT t, {mv.label_sql('site')} AS site, 'in' AS direction, sum(value) / {RANGE}.0E0 * 8 AS value
      FROM ({_IN}) GROUP BY ALL
    UNION ALL SELECT t, {mv.label_sql('site')}, 'out', sum(value) / {RANGE}.0E0 * 8 * -1 FROM ({_OUT}) GROUP BY ALL"""))
def site_bandwidth(spark, sf):
    grown = m.increase(
        mv.samples(spark, sf, "ifHCInOctets", "ifHCOutOctets"), RANGE, STEP, ["metric", "series_key"]
    )
    direction = F.when(F.col("metric") == "ifHCInOctets", "in").otherwise("out").alias("direction")
    summed = grown.groupBy("t", label(F.col("series_key"), "site").alias("site"), direction).agg(
        F.sum("value").alias("value")
    )
    sign = F.when(F.col("direction") == "in", 1).otherwise(-1)
    return m.scale(_per_second(summed), lambda x: x * sign)


_BOTH = f"""SELECT series_key, t, a.value + b.value AS value FROM ({_IN}) a JOIN ({_OUT}) b USING (series_key, t)"""
_DEVICE_SQL = f"""SELECT t, {mv.label_sql('instance')} AS instance, sum(value) / {RANGE}.0E0 * 8 AS value
    FROM ({_BOTH}) GROUP BY ALL"""


def both_directions(spark, sf):
    """Growth of both directions added up, for interfaces that have both."""
    grown = m.increase(
        mv.samples(spark, sf, "ifHCInOctets", "ifHCOutOctets"), RANGE, STEP, ["metric", "series_key"]
    )
    both = m.side_by_side(grown, ["ifHCInOctets", "ifHCOutOctets"])
    return both.select(
        "series_key", "t", (F.col("ifHCInOctets") + F.col("ifHCOutOctets")).alias("value")
    ).where(F.col("value").isNotNull())


def device_totals(spark, sf):
    return _per_second(m.aggregate(both_directions(spark, sf), "sum", ["instance"]))


@query("device_traffic", sql(_DEVICE_SQL))
def device_traffic(spark, sf):
    return device_totals(spark, sf)


def _means(where="true", metric="up"):
    return mv.grid_sql(f"(SELECT * FROM v_m_{metric} WHERE {where})", "sum(value) / count(*)", DAY, STEP)


def _mean_up(spark, sf, **regex):
    up = m.select_series(mv.samples(spark, sf, "up"), "up", regex={"job": "snmp|gnmic", **regex})
    return m.avg_over_time(up, DAY, STEP)


def _percent(vector):
    return m.scale(vector, lambda x: F.round(x * 100, 6))


@query("availability_global", sql(f"""
    SELECT t, round(avg(value) * 100, 6) AS value FROM ({_means(PULL)}) GROUP BY t"""))
def availability_global(spark, sf):
    return _percent(m.aggregate(_mean_up(spark, sf), "avg"))


@query("availability_by_site", sql(f"""
    SELECT t, {mv.label_sql('site')} AS site, round(avg(value) * 100, 6) AS value FROM ({_means(PULL)}) GROUP BY ALL"""))
def availability_by_site(spark, sf):
    return _percent(m.aggregate(_mean_up(spark, sf, site=any_of(None)), "avg", ["site"]))


@query("probe_success_rate", sql(f"""
    SELECT t, {mv.label_sql('module')} AS module, round(avg(value) * 100, 6) AS value
    FROM ({_means(metric='probe_success')}) GROUP BY ALL"""))
def probe_success_rate(spark, sf):
    means = m.avg_over_time(mv.samples(spark, sf, "probe_success"), DAY, STEP)
    return _percent(m.aggregate(means, "avg", ["module"]))


# ------------------------------------------------------------ top-k per time


def _topk_sql(source, k, tie):
    return f"""SELECT * FROM ({source})
        QUALIFY row_number() OVER (PARTITION BY t ORDER BY value DESC, {tie}) <= {k}"""


def _bits(metric):
    return f"SELECT series_key, t, value * 8 AS value FROM ({mv.rate_sql(metric, RANGE, STEP)})"


for _name, _metric in (("topk_interfaces_in", "ifHCInOctets"), ("topk_interfaces_out", "ifHCOutOctets")):

    @query(_name, sql(_topk_sql(_bits(_metric), 20, "series_key")))
    def _topk_interfaces(spark, sf, metric=_metric):
        bits = m.scale(m.rate(mv.samples(spark, sf, metric), RANGE, STEP), lambda x: x * 8)
        return m.topk(bits, 20)


@query("topk_devices", sql(_topk_sql(_DEVICE_SQL, 20, "instance")))
def topk_devices(spark, sf):
    return m.topk(device_totals(spark, sf), 20)


@query("topk_devices_over_time", sql(_topk_sql(_DEVICE_SQL, 10, "instance")))
def topk_devices_over_time(spark, sf):
    return m.topk(device_totals(spark, sf), 10)


@query("topk_errors", sql(_topk_sql(f"""
    SELECT series_key, t, a.value + b.value AS value FROM ({mv.rate_sql('ifInErrors', RANGE, STEP)}) a
    JOIN ({mv.rate_sql('ifOutErrors', RANGE, STEP)}) b USING (series_key, t)""", 10, "series_key")))
def topk_errors(spark, sf):
    both = matched(spark, sf, "ifInErrors", "ifOutErrors")
    total = both.select("series_key", "t", (F.col("ifInErrors") + F.col("ifOutErrors")).alias("value"))
    return m.topk(total.where(F.col("value").isNotNull()), 10)


# ------------------------------------------------------------ gaps, carry-forward


@query("stale_series", sql("""
    SELECT series_key, p AS silent_from, ts AS silent_to, (epoch_us(ts) - epoch_us(p)) / 1000000.0E0 AS gap_seconds
    FROM (SELECT *, lag(ts) OVER (PARTITION BY series_key ORDER BY ts) AS p FROM v_m_up)
    WHERE epoch_us(ts) - epoch_us(p) > 64800000000"""))
def stale_series(spark, sf):
    return m.gaps(mv.samples(spark, sf, "up"), STEP, 3)


@query("locf_grid", sql(f"""
    WITH g AS (SELECT series_key, unnest(generate_series(min(e), max(e))) AS e FROM (
        SELECT series_key, CAST(ceil(epoch_us(ts) / {STEP * 1_000_000}) AS BIGINT) AS e FROM v_m_bgpPeerState)
        GROUP BY series_key),
    g2 AS (SELECT series_key, make_timestamp(e * {STEP * 1_000_000}) AS t FROM g)
    SELECT g2.series_key, g2.t, s.value FROM g2 ASOF JOIN v_m_bgpPeerState s
      ON g2.series_key = s.series_key AND g2.t >= s.ts"""))
def locf_grid(spark, sf):
    return m.carry_forward(mv.samples(spark, sf, "bgpPeerState"), STEP)


# ------------------------------------------------------------ store operations

_SUMMARY = """count(*) AS sample_count, sum(value) AS sample_sum, min(value) AS sample_min, max(value) AS sample_max,
    arg_min(value, ts) AS sample_first, arg_max(value, ts) AS sample_last, max(c) - min(c) AS counter_growth"""


def _downsample_sql(metric, width):
    return sql(f"""SELECT series_key, time_bucket(INTERVAL '{width}', ts) AS window_start, {_SUMMARY}
        FROM {mv.counted_sql(metric)} GROUP BY ALL""")


@query("downsample_5m", _downsample_sql("ifHCInOctets", "5 minutes"))
def downsample_5m(spark, sf):
    return m.downsample(mv.samples(spark, sf, "ifHCInOctets"), 300)


@query("downsample_1h", _downsample_sql("ifHCInOctets", "1 hour"))
def downsample_1h(spark, sf):
    return m.downsample(mv.samples(spark, sf, "ifHCInOctets"), 3600)


@query("downsample_5m_to_1h", _downsample_sql("target_sync_errors_total", "1 hour"))
def downsample_5m_to_1h(spark, sf):
    return m.downsample_further(m.downsample(mv.samples(spark, sf, "target_sync_errors_total"), 300), 3600)


@query("downsample_1h_to_1d", _downsample_sql("ifHCInOctets", "1 day"))
def downsample_1h_to_1d(spark, sf):
    return m.downsample_further(m.downsample(mv.samples(spark, sf, "ifHCInOctets"), 3600), DAY)


METRIC_AS_OF = "2024-02-20 00:00:00"
_TIER_TIMES = {"raw": "ts", "5m": "time_bucket(INTERVAL '5 minutes', ts)", "1h": "time_bucket(INTERVAL '1 hour', ts)"}


@query("retention_metric_tiers", sql(" UNION ALL ".join(
    f"""SELECT '{tier}' AS tier, count(*) AS rows_kept, min(moment) AS oldest FROM (
        SELECT {'' if tier == 'raw' else 'DISTINCT'} series_key, {time} AS moment FROM v_m_ifHCInOctets)
        WHERE moment > TIMESTAMP '{METRIC_AS_OF}' - INTERVAL {METRIC_RETENTION_DAYS[tier]} DAY"""
    for tier, time in _TIER_TIMES.items())))
def retention_metric_tiers(spark, sf):
    """What each resolution of a metric still holds."""
    samples = mv.samples(spark, sf, "ifHCInOctets")
    tiers = [("raw", samples, "ts"), ("5m", m.downsample(samples, 300), "window_start"), ("1h", m.downsample(samples, 3600), "window_start")]
    result = None
    for name, df, column in tiers:
        part = retained(df, column, METRIC_AS_OF, METRIC_RETENTION_DAYS[name]).agg(
            F.lit(name).alias("tier"), F.count(F.lit(1)).alias("rows_kept"), ntz(F.min(column)).alias("oldest")
        )
        result = part if result is None else result.unionByName(part)
    return result


def _store_key(dc, replica):
    return (
        f"""concat('{{"cluster":"main","datacenter":"{dc}","instance":"', instance, '","replica":"{replica}","site":"', """
        """site, '"}')"""
    )


@query("federated_union", sql(f"""
    SELECT 'device_cpu_utilization' AS metric, {_store_key('dc1', 'a')} AS series_key, ts, value
      FROM v_m_device_cpu_utilization
    UNION ALL SELECT 'device_memory_utilization', {_store_key('dc2', 'b')}, ts, value
      FROM v_m_device_memory_utilization"""))
def federated_union(spark, sf):
    stores = {
        "one": mv.samples(spark, sf, "device_cpu_utilization"),
        "two": mv.samples(spark, sf, "device_memory_utilization"),
    }
    external = {
        "one": {"cluster": "main", "datacenter": "dc1", "replica": "a"},
        "two": {"cluster": "main", "datacenter": "dc2", "replica": "b"},
    }
    both = m.federate(stores, external)
    return both.select("metric", "series_key", ntz(F.col("ts")).alias("ts"), "value")


@query("replica_dedup", sql(f"""
    WITH r AS (
      SELECT instance, ts, site, 'a' AS replica, CAST(cents AS DOUBLE) AS value FROM v_scrape_base WHERE job != 'snmp'
      UNION ALL SELECT instance, ts, site, 'b', CAST(cents + 1 AS DOUBLE) FROM v_scrape_base WHERE job != 'gnmic')
    SELECT 'load' AS metric, {mv.key_sql(['instance', 'site'])} AS series_key, ts, arg_min(value, replica) AS value
    FROM r GROUP BY ALL"""))
def replica_dedup(spark, sf):
    """Two scrapers that each miss some devices: every reading once, the first replica's if both have it."""
    scraped = mv.scrapes(spark, sf)

    def replica(name, missing, shift):
        labels = F.create_map(
            F.lit("instance"), F.col("instance"), F.lit("replica"), F.lit(name), F.lit("site"), F.col("site")
        )
        return scraped.where(F.col("job") != missing).select(
            F.lit("load").alias("metric"), labels.alias("labels"), "ts",
            (F.col("cents") + shift).cast("double").alias("value"),
        )

    return m.drop_replicas(replica("a", "snmp", 0).unionByName(replica("b", "gnmic", 1)))
