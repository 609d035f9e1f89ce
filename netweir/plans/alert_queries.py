"""Alert queries over the test tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from netweir.functions.labels import label
from netweir.operators import alerts as al
from netweir.operators import vectors as m
from netweir.plans import metric_queries as mq
from netweir.plans import metric_views as mv
from netweir.plans import views as v
from netweir.plans.metric_views import DAY, STEP
from netweir.plans.registry import query
from netweir.plans.views_sql import VIEWS, sql

# One minute of the rules is one evaluation step of this data.
STRETCH = STEP // 60
RULES = {name: rule.stretched(STRETCH) for name, rule in al.RULES.items()}
RANGE = mq.RANGE


# ------------------------------------------------------------ conditions

def _grid(spark, sf, metric, **matchers):
    return m.on_grid(m.select_series(mv.samples(spark, sf, metric), metric, **matchers), STEP, DAY)


def _age(vector, seconds):
    """Evaluation time minus the timestamp the gauge holds, where it exceeds a limit."""
    aged = vector.withColumn(
        "value", F.unix_seconds(F.col("t").cast("timestamp")).cast("double") - F.col("value")
    )
    return m.keep_where(aged, lambda x: x > seconds)


def _phase(spark, sf, phase):
    return _grid(spark, sf, "runbook_execution_phase", equal={"phase": phase})


def anomalies(spark, sf):
    return al.flow_anomalies(v.event_flows(spark, sf), bucket_s=STEP, baseline=12)


CONDITIONS = {
    "DeviceDown": lambda s, d: m.keep_where(_grid(s, d, "up", equal={"job": "gnmic"}), lambda x: x == 0),
    "DeviceUnreachable": lambda s, d: m.keep_where(mq.pulled_up(s, d), lambda x: x == 0),
    "InterfaceErrors": lambda s, d: m.keep_where(mq.iface_error_ratio(s, d), lambda x: x > 0.01),
    "InterfaceErrorRate": lambda s, d: mq.error_share(s, d),
    "BGPSessionDown": lambda s, d: m.keep_where(_grid(s, d, "bgpPeerState"), lambda x: x != 6),
    "BGPSessionStateDown": lambda s, d: m.keep_where(_grid(s, d, "bgp_session_state"), lambda x: x != 6),
    "HighCPUUtilization": lambda s, d: m.keep_where(_grid(s, d, "cpu_utilization"), lambda x: x > 80),
    "HighMemoryUtilization": lambda s, d: m.keep_where(_grid(s, d, "memory_utilization"), lambda x: x > 85),
    "HighCPU": lambda s, d: m.keep_where(_grid(s, d, "device_cpu_utilization"), lambda x: x > 80),
    "HighMemory": lambda s, d: m.keep_where(_grid(s, d, "device_memory_utilization"), lambda x: x > 85),
    "TargetSyncErrorsIncreasing": lambda s, d: m.keep_where(mq.sync_errors_increase(s, d), lambda x: x > 0),
    "TargetSyncStale": lambda s, d: _age(_grid(s, d, "target_sync_last_success_timestamp"), 900),
    "RunbookPendingApprovalTooLong": lambda s, d: _age(_phase(s, d, "PendingApproval"), 3600),
    "RunbookExecutionFailed": lambda s, d: m.keep_where(_phase(s, d, "Failed"), lambda x: x == 1),
    "RunbookRollbackTriggered": lambda s, d: m.keep_where(_phase(s, d, "RollingBack"), lambda x: x == 1),
    "FlowRateAnomaly": lambda s, d: anomalies(s, d).where("is_anomaly").select(
        F.concat(F.lit('{"exporter":"'), F.col("exporter_ip").cast("string"), F.lit('"}')).alias("series_key"),
        "t",
        F.col("bytes").cast("double").alias("value"),
    ),
}


def _latest(metric, where, keep):
    source = f"(SELECT * FROM v_m_{metric} WHERE {where})"
    grid = mv.grid_sql(source, "arg_max(value, ts)", DAY, STEP, include_end=True)
    return f"SELECT * FROM ({grid}) WHERE {keep}"


def _aged(metric, where, seconds):
    source = f"(SELECT * FROM v_m_{metric} WHERE {where})"
    grid = mv.grid_sql(source, "arg_max(value, ts)", DAY, STEP, include_end=True)
    return f"""SELECT series_key, t, epoch_us(t) / 1000000 - value AS value FROM ({grid})
        WHERE epoch_us(t) / 1000000 - value > {seconds}"""


VIEWS["v_flow_anomaly"] = f"""
  SELECT exporter_ip, make_timestamp(k * {STEP} * 1000000) AS t, bytes, s / n AS baseline_mean,
      sqrt(CAST(n * q - s * s AS DOUBLE)) / n AS baseline_stddev,
      abs(CAST(n * bytes - s AS DOUBLE)) > 2.0E0 * sqrt(CAST(n * q - s * s AS DOUBLE)) AS is_anomaly
  FROM (SELECT *, count(*) OVER w AS n, sum(CAST(bytes AS HUGEINT)) OVER w AS s,
            sum(CAST(bytes AS HUGEINT) * bytes) OVER w AS q
        FROM (SELECT exporter_ip, epoch_us(ts) // ({STEP} * CAST(1000000 AS BIGINT)) AS k,
                  CAST(sum(bytes) AS BIGINT) AS bytes FROM v_event_flows GROUP BY ALL)
        WINDOW w AS (PARTITION BY exporter_ip ORDER BY k RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE n >= 2"""

_PHASE = "runbook_execution_phase"
CONDITION_SQL = {
    "DeviceDown": _latest("up", "job = 'gnmic'", "value = 0"),
    "DeviceUnreachable": _latest("up", mq.PULL, "value = 0"),
    "InterfaceErrors": f"""SELECT series_key, t, e.value / nullif(p.value, 0) AS value
        FROM ({mv.rate_sql('interface_errors_total', RANGE, STEP)}) e
        JOIN ({mv.rate_sql('interface_packets_total', RANGE, STEP)}) p USING (series_key, t)
        WHERE e.value / nullif(p.value, 0) > 0.01""",
    "InterfaceErrorRate": f"SELECT * FROM ({mq.ERROR_SHARE_SQL})",
    "BGPSessionDown": _latest("bgpPeerState", "true", "value != 6"),
    "BGPSessionStateDown": _latest("bgp_session_state", "true", "value != 6"),
    "HighCPUUtilization": _latest("cpu_utilization", "true", "value > 80"),
    "HighMemoryUtilization": _latest("memory_utilization", "true", "value > 85"),
    "HighCPU": _latest("device_cpu_utilization", "true", "value > 80"),
    "HighMemory": _latest("device_memory_utilization", "true", "value > 85"),
    "TargetSyncErrorsIncreasing":
        f"SELECT * FROM ({mv.increase_sql('target_sync_errors_total', RANGE, STEP)}) WHERE value > 0",
    "TargetSyncStale": _aged("target_sync_last_success_timestamp", "true", 900),
    "RunbookPendingApprovalTooLong": _aged(_PHASE, "phase = 'PendingApproval'", 3600),
    "RunbookExecutionFailed": _latest(_PHASE, "phase = 'Failed'", "value = 1"),
    "RunbookRollbackTriggered": _latest(_PHASE, "phase = 'RollingBack'", "value = 1"),
    "FlowRateAnomaly": """SELECT concat('{"exporter":"', exporter_ip, '"}') AS series_key, t,
        CAST(bytes AS DOUBLE) AS value FROM v_flow_anomaly WHERE is_anomaly""",
}

# States by islands: number the active steps; steps minus number is constant in a run.
for _name, _text in CONDITION_SQL.items():
    _rule = RULES[_name]
    VIEWS[f"v_active_{_name}"] = f"""
      SELECT *, min(t) OVER (PARTITION BY series_key, island) AS since, max(t) OVER (PARTITION BY series_key, island) AS until
      FROM (SELECT series_key, t, value, epoch_us(t) // ({STEP} * CAST(1000000 AS BIGINT))
                - row_number() OVER (PARTITION BY series_key ORDER BY t) AS island FROM ({_text}))"""
    VIEWS[f"v_states_{_name}"] = f"""
      SELECT '{_name}' AS alertname, '{_rule.severity}' AS severity, series_key, t, value,
          CASE WHEN t - since >= to_seconds({_rule.for_s}) THEN 'firing' ELSE 'pending' END AS alertstate,
          t - since = to_seconds({-(-_rule.for_s // STEP) * STEP}) AS just_fired
      FROM v_active_{_name}"""
    VIEWS[f"v_intervals_{_name}"] = f"""
      SELECT '{_name}' AS alertname, '{_rule.severity}' AS severity, series_key, since AS active_at,
          CASE WHEN until - since >= to_seconds({_rule.for_s}) THEN since + to_seconds({-(-_rule.for_s // STEP) * STEP}) END
              AS firing_at,
          until + to_seconds({STEP}) AS resolved_at
      FROM v_active_{_name} GROUP BY series_key, since, until"""

# The overview queries look at the alerts of all rules.
OVERVIEW = list(RULES)
for _kind in ("states", "intervals"):
    VIEWS[f"v_alert_{_kind}"] = " UNION ALL ".join(f"SELECT * FROM v_{_kind}_{name}" for name in OVERVIEW)


# Rules on the newest reading of a gauge: metric, label matchers, value of the alert, condition on it.
def _age_of(value):
    return F.unix_seconds(F.col("t").cast("timestamp")).cast("double") - value


def _labelled(name, *values):
    return label(F.col("series_key"), name).isin(*values)


_PHASES = "runbook_execution_phase"
GAUGES = {
    "DeviceDown": ("up", lambda: _labelled("job", "gnmic"), lambda x: x, lambda x: x == 0),
    "DeviceUnreachable": ("up", lambda: _labelled("job", "snmp", "gnmic"), lambda x: x, lambda x: x == 0),
    "BGPSessionDown": ("bgpPeerState", None, lambda x: x, lambda x: x != 6),
    "BGPSessionStateDown": ("bgp_session_state", None, lambda x: x, lambda x: x != 6),
    "HighCPU": ("device_cpu_utilization", None, lambda x: x, lambda x: x > 80),
    "HighCPUUtilization": ("cpu_utilization", None, lambda x: x, lambda x: x > 80),
    "HighMemory": ("device_memory_utilization", None, lambda x: x, lambda x: x > 85),
    "HighMemoryUtilization": ("memory_utilization", None, lambda x: x, lambda x: x > 85),
    "TargetSyncStale": ("target_sync_last_success_timestamp", None, _age_of, lambda x: x > 900),
    "RunbookPendingApprovalTooLong": (_PHASES, lambda: _labelled("phase", "PendingApproval"), _age_of, lambda x: x > 3600),
    "RunbookExecutionFailed": (_PHASES, lambda: _labelled("phase", "Failed"), lambda x: x, lambda x: x == 1),
    "RunbookRollbackTriggered": (_PHASES, lambda: _labelled("phase", "RollingBack"), lambda x: x, lambda x: x == 1),
}


def gauge_alerts(spark, sf, names):
    """The conditions of all gauge rules from one pass over the readings."""
    metrics = sorted({GAUGES[n][0] for n in names})
    grid = m.on_grid(mv.samples(spark, sf, *metrics), STEP, DAY, ["metric", "series_key"])
    found = {metric: [] for metric in metrics}
    for name in names:
        metric, matcher, value, condition = GAUGES[name]
        rule, x = RULES[name], value(F.col("value"))
        row = [F.lit(name).alias("alertname"), F.lit(rule.severity).alias("severity"), x.alias("value"), F.lit(al.need_of(rule, STEP)).alias("need")]
        found[metric].append(F.when(condition(x) & (matcher() if matcher else F.lit(True)), F.struct(*row)))
    # A reading is held against the rules of its own metric only.
    hits = F.coalesce(*[F.when(F.col("metric") == metric, F.array(*rules)) for metric, rules in found.items()])
    return grid.select("series_key", "t", F.explode(hits).alias("r")).where(F.col("r").isNotNull()).select(
        "r.alertname", "r.severity", "series_key", "t", "r.value", "r.need"
    )


def tagged(spark, sf, names):
    """The conditions of the named rules, each row with its rule."""
    gauges, others = [n for n in names if n in GAUGES], [n for n in names if n not in GAUGES]
    parts = [gauge_alerts(spark, sf, gauges)] if gauges else []
    parts += [al.with_rule(CONDITIONS[n](spark, sf), RULES[n], STEP) for n in others]
    return _union(parts)


def states_of(spark, sf, names):
    return al.states(tagged(spark, sf, names), [al.need_of(RULES[name], STEP) for name in names], STEP)


def rule_states(spark, sf, name):
    return states_of(spark, sf, [name])


def _union(parts):
    result = None
    for part in parts:
        result = part if result is None else result.unionByName(part)
    return result


def all_states(spark, sf):
    return states_of(spark, sf, OVERVIEW)


def intervals_of(spark, sf, names):
    return al.intervals(tagged(spark, sf, names), STEP)


def all_intervals(spark, sf):
    return intervals_of(spark, sf, OVERVIEW)


# ------------------------------------------------------------ one query per rule

_STATE_COLUMNS = "alertname, severity, series_key, t, alertstate, value"


def _rule_query(key, names):
    @query(key, sql(" UNION ALL ".join(f"SELECT {_STATE_COLUMNS} FROM v_states_{n}" for n in names)))
    def run(spark, sf):
        return states_of(spark, sf, names).drop("just_fired")


_rule_query("alert_device_down", ["DeviceDown", "DeviceUnreachable"])
_rule_query("alert_iface_errors", ["InterfaceErrors", "InterfaceErrorRate"])
_rule_query("alert_bgp_down", ["BGPSessionDown", "BGPSessionStateDown"])
_rule_query("alert_high_cpu", ["HighCPU", "HighCPUUtilization"])
_rule_query("alert_high_memory", ["HighMemory", "HighMemoryUtilization"])
_rule_query("alert_sync_errors", ["TargetSyncErrorsIncreasing"])
_rule_query("alert_sync_stale", ["TargetSyncStale"])
_rule_query("alert_pending_approval", ["RunbookPendingApprovalTooLong"])
_rule_query("alert_exec_failed", ["RunbookExecutionFailed"])
_rule_query("alert_rollback", ["RunbookRollbackTriggered"])
_rule_query("alert_flow_anomaly", ["FlowRateAnomaly"])
_rule_query("alert_states", OVERVIEW)


@query("flow_anomaly", sql("SELECT * FROM v_flow_anomaly"))
def flow_anomaly(spark, sf):
    return anomalies(spark, sf)


@query("alert_intervals", sql("SELECT * FROM v_alert_intervals"))
def alert_intervals(spark, sf):
    return all_intervals(spark, sf)


RUNBOOK_SITE = "https://runbooks.example.net"


def _annotation_sql(template):
    """The text of a rule with its labels filled in."""
    pieces = re.split(r"(\{\w+\})", template)
    number = "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"
    parts = [
        (number if p == "{value}" else mv.label_sql(p[1:-1])) if re.fullmatch(r"\{\w+\}", p) else "'" + p.replace("'", "''") + "'"
        for p in pieces if p
    ]
    return f"concat({', '.join(parts)})" if parts else "''"


@query("alert_annotations", sql(" UNION ALL ".join(
    f"""SELECT alertname, series_key, t, {_annotation_sql(r.summary)} AS summary, {_annotation_sql(r.description)} AS description,
        {f"'{RUNBOOK_SITE}/{r.runbook}'" if r.runbook else "''"} AS runbook_url FROM v_states_{r.name}"""
    for r in RULES.values())))
def alert_annotations(spark, sf):
    return al.annotated(all_states(spark, sf), list(RULES.values()), RUNBOOK_SITE).select(
        "alertname", "series_key", "t", "summary", "description", "runbook_url"
    )


# ------------------------------------------------------------ overview panels


def _firing(spark, sf):
    return all_states(spark, sf).where(F.col("alertstate") == "firing")


@query("alerts_table", sql(f"""
    SELECT alertname AS "Alert Name", severity AS "Severity", {mv.label_sql('site')} AS "Site",
        {mv.label_sql('instance')} AS "Device", t AS "Time" FROM v_alert_states WHERE alertstate = 'firing'"""))
def alerts_table(spark, sf):
    key = F.col("series_key")
    table = _firing(spark, sf).select(
        "alertname", "severity", label(key, "site").alias("site"), label(key, "instance").alias("instance"), "t"
    )
    return table.withColumnsRenamed(
        {"alertname": "Alert Name", "severity": "Severity", "site": "Site", "instance": "Device", "t": "Time"}
    )


def _count_query(key, columns):
    select = {"site": f"{mv.label_sql('site')} AS site", "alertname": "alertname", "severity": "severity"}
    named = "".join(f", {select[c]}" for c in columns)

    @query(key, sql(f"SELECT t{named}, count(*) AS value FROM v_alert_states WHERE alertstate = 'firing' GROUP BY ALL"))
    def run(spark, sf):
        firing = _firing(spark, sf).withColumn("site", label(F.col("series_key"), "site"))
        return firing.groupBy("t", *columns).agg(F.count(F.lit(1)).alias("value"))


_count_query("active_alerts", [])
_count_query("alerts_by_severity", ["severity"])
_count_query("alerts_by_site", ["site"])
_count_query("alerts_by_name_ts", ["alertname"])
_count_query("alerts_by_site_severity", ["site", "severity"])


# ------------------------------------------------------------ dedup, groups, routes, notifications


@query("alert_dedup", sql("SELECT alertname, severity, series_key, active_at, firing_at, resolved_at FROM v_alert_intervals"))
def alert_dedup(spark, sf):
    """Two rulers report the same alerts; what is left is one copy of each."""
    found = all_intervals(spark, sf)
    replicas = found.withColumn("ruler_replica", F.explode(F.array(F.lit("ruler-0"), F.lit("ruler-1"))))
    return al.drop_ruler_replicas(replicas)


_GROUP_SQL = f"{mv.label_sql('site')} AS datacenter, {mv.label_sql('instance')} AS device"
_GROUP_LABELS = {"datacenter": "site", "device": "instance"}


@query("alert_groups", sql(f"""
    SELECT alertname, {_GROUP_SQL}, count(*) AS alert_count, count(firing_at) AS fired_count,
        min(active_at) AS first_active_at, max(resolved_at) AS last_resolved_at FROM v_alert_intervals GROUP BY ALL"""))
def alert_groups(spark, sf):
    return al.groups(al.with_group(all_intervals(spark, sf), _GROUP_LABELS), al.GROUP_BY)


_ROUTE_SQL = """CASE severity WHEN 'critical' THEN 'pagerduty' WHEN 'warning' THEN 'slack' WHEN 'info' THEN 'email'
    ELSE 'default' END AS receiver, CASE severity WHEN 'critical' THEN 300 WHEN 'warning' THEN 3600
    WHEN 'info' THEN 43200 ELSE 14400 END AS repeat_s"""


@query("alert_routing", sql(f"""
    SELECT series_key, alertname, firing_at, severity, {_ROUTE_SQL} FROM (
      SELECT series_key, alertname, firing_at,
        CASE {mv.label_sql('site')} WHEN 'site5' THEN 'info' WHEN 'site6' THEN 'none' ELSE severity END
        AS severity FROM v_alert_intervals WHERE firing_at IS NOT NULL)"""))
def alert_routing(spark, sf):
    """Firing alerts and where they go; two sites override the severity of their alerts."""
    site = label(F.col("series_key"), "site")
    severity = F.when(site == "site5", "info").when(site == "site6", "none").otherwise(F.col("severity"))
    fired = all_intervals(spark, sf).where(F.col("firing_at").isNotNull()).withColumn("severity", severity)
    return al.routed(fired).select("series_key", "alertname", "firing_at", "severity", "receiver", "repeat_s")


WAIT, EVERY = al.GROUP_WAIT_S * STRETCH, al.GROUP_INTERVAL_S * STRETCH


def schedule_inputs(spark, sf):
    """Firing steps with their group columns and stretched repeat interval."""
    grouped = al.routed(al.with_group(_firing(spark, sf), _GROUP_LABELS))
    return grouped.withColumn("repeat_s", F.col("repeat_s") * STRETCH)


_SCHEDULE = f"""
    WITH s AS (SELECT alertname, {_GROUP_SQL}, epoch_us(t) AS us, max(CAST(just_fired AS INTEGER)) AS changed,
        min(CASE severity WHEN 'critical' THEN 300 ELSE 3600 END) * {STRETCH} AS repeat_s
        FROM v_alert_states WHERE alertstate = 'firing' GROUP BY ALL),
    g AS (SELECT *, us // ({STEP} * CAST(1000000 AS BIGINT))
        - row_number() OVER (PARTITION BY alertname, datacenter, device ORDER BY us) AS island FROM s),
    i AS (SELECT *, min(us) OVER p + {WAIT} * CAST(1000000 AS BIGINT) AS start_us,
        max(us) OVER p + {STEP} * CAST(1000000 AS BIGINT) AS end_us FROM g
        WINDOW p AS (PARTITION BY alertname, datacenter, device, island)),
    c AS (SELECT DISTINCT alertname, datacenter, device, end_us, repeat_s,
        start_us + CAST(ceil(greatest(us - start_us, 0) / ({EVERY} * 1000000.0E0)) AS BIGINT)
            * {EVERY} * CAST(1000000 AS BIGINT) AS tick FROM i WHERE changed = 1),
    n AS (SELECT *, coalesce(lead(tick) OVER (PARTITION BY alertname, datacenter, device ORDER BY tick), end_us) AS nxt
        FROM c WHERE tick < end_us)
    SELECT alertname, datacenter, device, make_timestamp(moment) AS notify_at,
        CASE WHEN moment = tick THEN 'new' ELSE 'repeat' END AS reason
    FROM (SELECT *, unnest(generate_series(tick, least(nxt, end_us) - 1,
        CAST(ceil(repeat_s / {EVERY}.0E0) AS BIGINT) * {EVERY} * CAST(1000000 AS BIGINT))) AS moment FROM n)"""
SCHEDULE_SQL = sql(_SCHEDULE)
RESOLVED_SQL = sql(f"""{_SCHEDULE}
    UNION ALL SELECT alertname, datacenter, device, make_timestamp(look), 'resolved' FROM (
      SELECT *, start_us + CAST(ceil((end_us - start_us) / ({EVERY} * 1000000.0E0)) AS BIGINT) * {EVERY} * CAST(1000000 AS BIGINT) AS look,
          lead(start_us) OVER (PARTITION BY alertname, datacenter, device ORDER BY start_us) - {WAIT} * CAST(1000000 AS BIGINT) AS again
      FROM (SELECT DISTINCT alertname, datacenter, device, start_us, end_us FROM i))
    WHERE start_us < end_us AND (again IS NULL OR again > look)""")


@query("notification_schedule", SCHEDULE_SQL)
def notification_schedule(spark, sf):
    return al.notifications(schedule_inputs(spark, sf), al.GROUP_BY, STEP, WAIT, EVERY)


@query("notification_resolved", RESOLVED_SQL)
def notification_resolved(spark, sf):
    return al.notifications(schedule_inputs(spark, sf), al.GROUP_BY, STEP, WAIT, EVERY, resolved=True)
