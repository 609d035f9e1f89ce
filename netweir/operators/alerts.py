"""Alerting: rule conditions to pending and firing states, intervals, groups, notifications.

A condition is a vector (``series_key, t, value``) that has a row where the rule's
expression holds. A series that misses one step stops being active.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions.labels import label
from netweir.functions.timing import floor_div, grid_time, micros
from netweir.operators.ordered import number_runs, overlapping_chunks, run_pieces, runs, with_neighbors

MICRO = 1_000_000
CHUNK = 512


@dataclass(frozen=True)
class Rule:
    """``runbook`` is the page of the rule below the site's runbook address, '' if it has none."""

    name: str
    severity: str
    for_s: int
    summary: str = ""
    description: str = ""
    runbook: str = ""

    def stretched(self, factor: int) -> Rule:
        """The rule for data on a slower clock."""
        return replace(self, for_s=self.for_s * factor)


# --- fixed values: names, severities and waits of the alert rules --------------
RULES = {
    rule.name: rule
    for rule in (
        Rule("DeviceDown", "critical", 120, "{device} ({site}): no telemetry", "The telemetry session with {instance} was lost.", "device-down"),
        Rule("DeviceUnreachable", "critical", 120, "{instance}: polling fails", "No poll of {instance} was answered."),
        Rule("InterfaceErrors", "warning", 300, "{device} {interface}: packet errors",
             "More than one packet in a hundred is bad on {device} {interface} ({site}).", "interface-errors"),
        Rule("InterfaceErrorRate", "warning", 300, "{instance} {ifName}: error counters grow",
             "Errors are more than 1% of the packets of {ifName} on {instance}."),
        Rule("BGPSessionDown", "critical", 60, "{instance}: peer {peer} lost", "{instance} has no established session with {peer}."),
        Rule("BGPSessionStateDown", "critical", 60, "{device}: neighbor {neighbor_address} lost",
             "{device} ({site}) has no established session with {neighbor_address}.", "bgp-session-down"),
        Rule("HighCPU", "warning", 300, "{instance}: processor at {value}%", "{instance} uses more than 80% of its processor."),
        Rule("HighCPUUtilization", "warning", 300, "{device}: processor busy", "{device} ({site}) uses more than 80% of its processor.", "high-cpu"),
        Rule("HighMemory", "warning", 300, "{instance}: memory at {value}%", "{instance} uses more than 85% of its memory."),
        Rule("HighMemoryUtilization", "warning", 300, "{device}: memory short", "{device} ({site}) uses more than 85% of its memory.", "high-memory"),
        Rule("TargetSyncErrorsIncreasing", "warning", 900, "Target lists: errors grow", "Every check found new errors of the target sync."),
        Rule("TargetSyncStale", "warning", 900, "Target lists: out of date", "No target sync has ended well for a quarter of an hour."),
        Rule("RunbookPendingApprovalTooLong", "warning", 300, "{name}: nobody approves", "{namespace}/{name} has waited for an approval for an hour."),
        Rule("RunbookExecutionFailed", "critical", 60, "{name}: failed", "{namespace}/{name} ended in failure."),
        Rule("RunbookRollbackTriggered", "critical", 60, "{name}: rolls back", "{namespace}/{name} undoes its steps."),
        Rule("FlowRateAnomaly", "warning", 0, "{exporter}: unusual traffic", "The bytes of {exporter} are two deviations off its baseline."),
    )
}

# --- fixed values: routes by severity, tried in order, first match wins --------
ROUTES = [
    ("critical", "pagerduty", 300),
    ("warning", "slack", 3600),
    ("info", "email", 43_200),
]
DEFAULT_ROUTE = ("default", 14_400)
GROUP_BY = ["alertname", "datacenter", "device"]
GROUP_WAIT_S = 30
GROUP_INTERVAL_S = 300


# ------------------------------------------------------------ states

def states(tagged: DataFrame, needs: list[int], step_s: int) -> DataFrame:
    """``pending`` or ``firing`` per active step: firing once active for all of ``for``.

    ``tagged`` holds the conditions of any number of rules, made by ``with_rule``, and
    ``needs`` the steps that these rules wait for. Whether a step fires depends only on the
    steps of the last ``for``, so the time axis is cut into chunks that overlap by that much.
    All rules share one window.
    """
    reach = max(needs, default=0) + 1
    chunk = max(CHUNK, reach)
    placed = tagged.withColumn("k", floor_div(micros(F.col("t")), step_s * MICRO))
    copies = overlapping_chunks(placed, "k", reach, chunk)
    by_time = Window.partitionBy("alertname", "series_key", "_chunk").orderBy("k")
    starts = F.coalesce(F.lag("k").over(by_time) != F.col("k") - 1, F.lit(True))
    # Steps since the activity began, or since the copies of earlier steps do, which is longer
    # than any rule waits.
    began = F.last(F.when(F.col("_starts"), F.col("k")), ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    marked = copies.withColumn("_starts", starts).withColumn("_held", F.col("k") - began)
    return marked.where(floor_div(F.col("k"), chunk) == F.col("_chunk")).select(
        "alertname", "severity", "series_key", "t", F.when(F.col("_held") >= F.col("need"), "firing").otherwise("pending").alias("alertstate"),
        "value", (F.col("_held") == F.col("need")).alias("just_fired"),
    )


def need_of(rule: Rule, step_s: int) -> int:
    """Steps a condition has to hold after the first one until the rule fires."""
    return -(-rule.for_s // step_s)


def with_rule(active: DataFrame, rule: Rule, step_s: int) -> DataFrame:
    """Tag a condition with its rule, so that several rules can go through one pass."""
    return active.select(
        F.lit(rule.name).alias("alertname"), F.lit(rule.severity).alias("severity"), "series_key", "t", "value",
        F.lit(need_of(rule, step_s)).alias("need"),
    )


def intervals(tagged: DataFrame, step_s: int) -> DataFrame:
    """One row per uninterrupted activity: when it became active, fired and was resolved.

    ``tagged`` holds the conditions of any number of rules, made by ``with_rule``.
    """
    placed = tagged.withColumn("k", floor_div(micros(F.col("t")), step_s * MICRO))
    found = runs(placed, ["alertname", "severity", "need", "series_key"], "k", CHUNK)
    fired = F.col("last") - F.col("first") >= F.col("need")
    return found.select(
        "alertname", "severity", "series_key",
        grid_time(F.col("first"), step_s).alias("active_at"),
        F.when(fired, grid_time(F.col("first") + F.col("need"), step_s)).alias("firing_at"),
        grid_time(F.col("last") + 1, step_s).alias("resolved_at"),
    )


def annotation(template: str, key: Column, value: Column) -> Column:
    """Text with ``{label}`` and ``{value}`` filled in; a missing label gives ''."""
    number = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            parts.append(number if piece == "{value}" else label(key, piece[1:-1]))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def annotated(found: DataFrame, rules: list[Rule], runbook_site: str) -> DataFrame:
    """Add each alert's texts and the address of its runbook ('' for a rule without one)."""
    def chosen(text) -> Column:
        out = F.lit("")
        for rule in rules:
            out = F.when(F.col("alertname") == rule.name, text(rule)).otherwise(out)
        return out

    key, value = F.col("series_key"), F.col("value")
    return found.withColumns(
        {
            "summary": chosen(lambda r: annotation(r.summary, key, value)),
            "description": chosen(lambda r: annotation(r.description, key, value)),
            "runbook_url": chosen(lambda r: F.lit(f"{runbook_site}/{r.runbook}" if r.runbook else "")),
        }
    )


def drop_ruler_replicas(alerts: DataFrame, column: str = "ruler_replica") -> DataFrame:
    return alerts.drop(column).distinct()


# ------------------------------------------------------------ anomaly

def flow_anomalies(
    flows: DataFrame, bucket_s: int = 300, baseline: int = 12, sigmas: int = 2, least: int = 2
) -> DataFrame:
    """Buckets whose bytes lie more than ``sigmas`` deviations from the exporter's baseline.

    The baseline is the traffic of the ``baseline`` bucket lengths before. Mean and
    deviation are compared through exact sums, so large totals lose no digits.
    """
    width = bucket_s * MICRO
    totals = (
        flows.withColumn("k", floor_div(micros(F.col("ts")), width))
        .groupBy("exporter_ip", "k")
        .agg(F.sum("bytes").alias("bytes"))
    )
    chunk = max(CHUNK, baseline)
    copies = overlapping_chunks(totals, "k", baseline, chunk).withColumn("x", F.col("bytes").cast("decimal(19,0)"))
    before = Window.partitionBy("exporter_ip", "_chunk").orderBy("k").rangeBetween(-baseline, -1)
    n = F.col("n").cast("decimal(9,0)")
    rows = (
        copies.withColumn("n", F.count("x").over(before))
        .withColumn("s", F.sum("x").over(before).cast("decimal(20,0)"))
        .withColumn("q", F.sum((F.col("x") * F.col("x")).cast("decimal(38,0)")).over(before).cast("decimal(34,0)"))
        .where((floor_div(F.col("k"), chunk) == F.col("_chunk")) & (F.col("n") >= least))
    )
    off = (n * F.col("x") - F.col("s")).cast("double")
    spread = F.sqrt((n * F.col("q") - F.col("s") * F.col("s")).cast("double"))
    return rows.select(
        "exporter_ip",
        grid_time(F.col("k"), bucket_s).alias("t"),
        "bytes",
        (F.col("s").cast("double") / F.col("n")).alias("baseline_mean"),
        (spread / F.col("n")).alias("baseline_stddev"),
        (F.abs(off) > F.lit(float(sigmas)) * spread).alias("is_anomaly"),
    )


# ------------------------------------------------------------ groups and notifications

def with_group(alerts: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Add the grouping columns; ``labels`` maps column to the label it is read from."""
    for column, source in labels.items():
        if column not in alerts.columns:
            alerts = alerts.withColumn(column, label(F.col("series_key"), source))
    return alerts


def groups(fired: DataFrame, by: list[str]) -> DataFrame:
    """One row per alert group with its size and extent; members stay in ``fired``."""
    return fired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.count("firing_at").alias("fired_count"),
        F.min("active_at").alias("first_active_at"),
        F.max("resolved_at").alias("last_resolved_at"),
    )


def routed(alerts: DataFrame) -> DataFrame:
    """Receiver and repeat interval by severity: the first matching route."""
    receiver, repeat = F.lit(DEFAULT_ROUTE[0]), F.lit(DEFAULT_ROUTE[1])
    for severity, name, seconds in reversed(ROUTES):
        hit = F.col("severity") == severity
        receiver, repeat = F.when(hit, name).otherwise(receiver), F.when(hit, seconds).otherwise(repeat)
    return alerts.withColumn("receiver", receiver).withColumn("repeat_s", repeat)


def notifications(
    firing: DataFrame,
    by: list[str],
    step_s: int,
    wait_s: int = GROUP_WAIT_S,
    interval_s: int = GROUP_INTERVAL_S,
    repeat: Column | None = None,
    resolved: bool = False,
) -> DataFrame:
    """When each group notifies.

    ``firing`` holds the firing steps with ``just_fired`` and ``repeat_s``. A group that
    starts firing waits ``wait_s``; then it is looked at every ``interval_s`` and notifies
    if an alert has joined since, or if the repeat interval has passed since the last
    notification. It is forgotten once no alert of it fires. With ``resolved``, a group that
    has notified says so at its first look after that, unless it fires again by then.
    """
    width = step_s * MICRO
    steps = (
        firing.withColumn("k", floor_div(micros(F.col("t")), width))
        .groupBy(*by, "k")
        .agg(
            F.max(F.col("just_fired").cast("int")).alias("changed"),
            F.min(F.col("repeat_s") if repeat is None else repeat).alias("repeat_s"),
        )
    )
    # A session is a stretch of steps; its changes stay with the pieces of a chunk that they are in.
    changes = F.collect_list(F.when(F.col("changed") == 1, F.struct("k", "repeat_s"))).alias("changes")
    pieces, whole = number_runs(run_pieces(steps, by, "k", CHUNK, changes), by, CHUNK)
    session = Window.partitionBy(*whole)
    bounds = pieces.withColumns({"start_k": F.min("first").over(session), "last_k": F.max("last").over(session)})
    placed = bounds.select(*by, "start_k", "last_k", F.explode("changes").alias("c")).select(*by, "start_k", "last_k", "c.k", "c.repeat_s")
    start_us = F.col("start_k") * width + wait_s * MICRO
    late_us = F.greatest(F.col("k") * width - start_us, F.lit(0))
    every = interval_s * MICRO
    ticks = (
        placed.withColumn("tick", start_us + F.ceil(late_us / F.lit(every)).cast("long") * every)
        .withColumn("end_us", (F.col("last_k") + 1) * width)
        .where(F.col("tick") < F.col("end_us"))
        .groupBy(*by, "tick", "end_us")
        .agg(F.min("repeat_s").alias("repeat_s"))
    )
    chained = with_neighbors(ticks, by, "tick", CHUNK * width, after={"tick": "next_tick"})
    again = (F.ceil(F.col("repeat_s") / F.lit(interval_s)) * interval_s).cast("long") * MICRO
    until = F.least(F.col("end_us"), F.coalesce("next_tick", "end_us")) - 1
    sent = chained.select(
        *by,
        F.explode(F.sequence(F.col("tick"), F.greatest("tick", until), again)).alias("at"),
        F.col("tick"),
    ).select(
        *by,
        F.timestamp_micros("at").cast("timestamp_ntz").alias("notify_at"),
        F.when(F.col("at") == F.col("tick"), "new").otherwise("repeat").alias("reason"),
    )
    if not resolved:
        return sent
    # The first step of a session always has a change.
    sessions = placed.where("k = start_k").select(*by, "start_k", start_us.alias("start_us"), ((F.col("last_k") + 1) * width).alias("end_us"))
    sessions = with_neighbors(sessions, by, "start_k", CHUNK, after={"start_k": "next_k"})
    look = F.col("start_us") + F.ceil((F.col("end_us") - F.col("start_us")) / F.lit(every)).cast("long") * every
    ended = sessions.withColumn("look", look).where("start_us < end_us").where(F.col("next_k").isNull() | (F.col("next_k") * width > F.col("look")))
    return sent.unionByName(ended.select(*by, F.timestamp_micros("look").cast("timestamp_ntz").alias("notify_at"), F.lit("resolved").alias("reason")))
