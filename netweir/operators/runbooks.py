"""Remediation history: definitions, parameters, phases, steps, approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.operators.joins import measured
from netweir.functions.timing import duration_seconds, elapsed_seconds, micros
from netweir.operators.ordered import with_neighbors

MICRO = 1_000_000
DAY = 86_400 * MICRO

# --- fixed values: phases an execution may go to from each phase ---------------
TRANSITIONS = {
    "Pending": ["PendingApproval", "Running", "Failed", "Cancelled"],
    "PendingApproval": ["Approved", "TimedOut", "Cancelled"],
    "Approved": ["Running", "Cancelled"],
    "Running": ["Completed", "Failed", "Cancelled"],
    "Failed": ["RollingBack"],
    "RollingBack": ["RolledBack", "Failed"],
}
# --- fixed values: why a definition is refused, in the order of the checks -----
NO_NAME = "runbook name is required"
NO_STEPS = "runbook must have at least one step"
NO_APPROVERS = "approvers required when requiresApproval is true"
STEP_NO_NAME = "name is required"
STEP_NO_ACTION = "action is required"
APPROVAL_TIMEOUT_S = 3600


# ------------------------------------------------------------ definitions

def validate_runbooks(runbooks: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``reason``; the first failed check gives the reason."""
    def empty(column: Column) -> Column:
        return F.coalesce(column, F.lit("")) == ""

    def step_problem(step: Column, position: Column) -> Column:
        where = F.concat(F.lit("step "), position.cast("string"), F.lit(": "))
        return F.when(empty(step["name"]), F.concat(where, F.lit(STEP_NO_NAME))).when(
            empty(step["action"]), F.concat(where, F.lit(STEP_NO_ACTION))
        )

    problems = F.filter(F.transform("steps", step_problem), lambda p: p.isNotNull())
    reason = (
        F.when(empty(F.col("name")), NO_NAME)
        .when(F.size("steps") == 0, NO_STEPS)
        .when(F.col("requires_approval") & (F.size("approvers") == 0), NO_APPROVERS)
        .otherwise(F.coalesce(F.get(problems, F.lit(0)), F.lit("")))
    )
    return runbooks.withColumn("reason", reason).withColumn("valid", F.col("reason") == "")


def validate_parameters(executions: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row per execution and declared parameter: its value after defaults, and any problem.

    executions: execution, runbook, parameters MAP.  definitions: runbook, parameter, type,
    required, default_value, validation (pattern), options ARRAY. A pattern that is none makes
    its own parameter a problem, not the query.
    """
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.coalesce("validation", F.lit("")))
    checked = definitions.withColumn("_usable", compiled.isNotNull())
    joined = executions.join(measured(checked), "runbook")
    given = F.try_element_at(F.col("parameters"), F.col("parameter"))
    value = F.coalesce(F.nullif(given, F.lit("")), F.nullif(F.col("default_value"), F.lit("")))
    rows = joined.withColumn("value", value)
    v = F.col("value")
    problem = (
        F.when(v.isNull() & F.col("required"), "missing")
        .when(v.isNull(), "")
        .when((F.col("type") == "integer") & v.try_cast("bigint").isNull(), "not an integer")
        .when((F.col("type") == "boolean") & ~F.lower(v).isin("true", "false"), "not a boolean")
        .when((F.col("type") == "select") & ~F.array_contains(F.col("options"), v), "not an option")
        .when(~F.col("_usable"), "bad pattern")
        .when((F.col("validation") != "") & ~F.rlike(v, F.col("validation")), "does not match")
        .otherwise("")
    )
    return rows.select("execution", "runbook", "parameter", "value", problem.alias("problem"))


# ------------------------------------------------------------ audit events

def timeline(events: DataFrame) -> DataFrame:
    """Audit events of each execution in order, with the time since the one before.

    events: the columns of an audit event. Events of one moment are ordered by type and step. An
    execution has a bounded number of events, so one task orders all of its own.
    """
    along = Window.partitionBy("namespace", "executionName").orderBy("timestamp", "eventType", "stepName")
    gap = (micros(F.col("timestamp")) - micros(F.lag("timestamp").over(along))) / F.lit(1_000_000)
    return events.select(
        "namespace", F.col("executionName").alias("execution"), F.row_number().over(along).cast("long").alias("position"),
        F.col("eventType").alias("event_type"), F.col("timestamp").alias("at"), gap.alias("seconds_since"),
    )


# ------------------------------------------------------------ executions

def with_runbook(executions: DataFrame, runbooks: DataFrame) -> DataFrame:
    """Executions with their definition; a reference without namespace means their own."""
    keyed = executions.withColumn(
        "runbook_namespace", F.coalesce(F.nullif(F.col("ref_namespace"), F.lit("")), F.col("namespace"))
    )
    return keyed.join(runbooks, ["runbook", "runbook_namespace"])


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Phase changes the life cycle does not know. events: execution, ts, phase."""
    slim = events.select("execution", "phase", micros(F.col("ts")).alias("us"))
    linked = with_neighbors(slim, ["execution"], "us", 30 * DAY, before={"phase": "previous_phase"}, ties=["phase"])
    legal = F.col("previous_phase").isNull() & (F.col("phase") == "Pending")
    for source, targets in TRANSITIONS.items():
        legal = legal | (F.coalesce(F.col("previous_phase"), F.lit("")) == source) & F.col("phase").isin(targets)
    return linked.where(~legal).select(
        "execution", "previous_phase", "phase", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts")
    )


def phase_dwell(events: DataFrame) -> DataFrame:
    """How long each phase lasted; the phase an execution is in last has no end."""
    slim = events.select("execution", "phase", micros(F.col("ts")).alias("us"))
    linked = with_neighbors(slim, ["execution"], "us", 30 * DAY, after={"us": "next_us"}, ties=["phase"])
    return linked.select(
        "execution", "phase",
        F.timestamp_micros("us").cast("timestamp_ntz").alias("entered_at"),
        ((F.col("next_us") - F.col("us")) / F.lit(float(MICRO))).alias("dwell_seconds"),
    )


def cooldown_violations(executions: DataFrame) -> DataFrame:
    """Executions that started too soon after the last one of the same runbook on the same device."""
    slim = executions.select("runbook", "device", "execution", micros(F.col("start_time")).alias("us"), "cooldown")
    linked = with_neighbors(
        slim, ["runbook", "device"], "us", 30 * DAY,
        before={"us": "previous_us", "execution": "previous_execution"}, ties=["execution"],
    )
    gap = (F.col("us") - F.col("previous_us")) / F.lit(float(MICRO))
    return linked.withColumn("gap_seconds", gap).where(F.col("gap_seconds") < duration_seconds(F.col("cooldown"))).select(
        "runbook", "device", "execution", "previous_execution", "gap_seconds"
    )


def step_outcomes(steps: DataFrame) -> DataFrame:
    """Replay of the steps: a step whose condition is false or empty is skipped, and so is
    everything after the first failed step that does not continue on error.

    steps: execution, step_index, failed, continue_on_error, condition (NULL = none).
    """
    met = F.col("condition").isNull() | ~F.col("condition").isin("false", "")
    hard = met & F.col("failed") & ~F.col("continue_on_error")
    # Only executions that stop early get here, one row each.
    stops = steps.where(hard).groupBy("execution").agg(F.min("step_index").alias("stop_index"))
    joined = steps.join(stops, "execution", "left")
    after_stop = F.coalesce(F.col("step_index") > F.col("stop_index"), F.lit(False))
    return joined.withColumn(
        "status",
        F.when(after_stop | ~met, "Skipped").when(F.col("failed"), "Failed").otherwise("Completed"),
    ).drop("stop_index")


def execution_kpis(executions: DataFrame) -> DataFrame:
    """Executions by phase and trigger with their durations in whole seconds."""
    timed = executions.withColumn("duration_s", elapsed_seconds(F.col("start_time"), F.col("completion_time")))
    return timed.groupBy("phase", "trigger_source").agg(
        F.count(F.lit(1)).alias("executions"),
        F.avg("duration_s").alias("avg_duration_s"),
        F.percentile("duration_s", F.lit(0.5)).alias("median_duration_s"),
        F.max("duration_s").alias("max_duration_s"),
    )


def pending_approvals(executions: DataFrame) -> DataFrame:
    """Executions that wait for approval, by runbook."""
    return executions.where(F.col("phase") == "PendingApproval").groupBy("runbook").agg(
        F.count(F.lit(1)).alias("pending"), F.min("created_at").cast("timestamp_ntz").alias("oldest")
    )


def approval_timeouts(executions: DataFrame, as_of: str) -> DataFrame:
    """Waiting executions whose approval time has run out. Needs ``approval_timeout``."""
    timeout = duration_seconds(F.col("approval_timeout"), APPROVAL_TIMEOUT_S)
    expires = F.timestamp_micros(micros(F.col("created_at")) + (timeout * MICRO).cast("long"))
    return (
        executions.where(F.col("phase") == "PendingApproval")
        .withColumn("expires", expires)
        .where(F.col("expires") < F.lit(as_of).cast("timestamp"))
        .select(
            "execution", timeout.alias("timeout_s"), F.lit("TimedOut").alias("phase"),
            F.col("expires").cast("timestamp_ntz").alias("timed_out_at"),
        )
    )


def remediation(alerts: DataFrame, executions: DataFrame) -> DataFrame:
    """Alerts with what was run for them. alerts: alert_id, …; executions: alert_ref, start_time."""
    runs = (
        executions.where(F.coalesce("alert_ref", F.lit("")) != "")
        .groupBy(F.col("alert_ref").alias("alert_id"))
        .agg(
            F.count(F.lit(1)).alias("executions"),
            F.min("start_time").cast("timestamp_ntz").alias("first_execution"),
            F.max("start_time").cast("timestamp_ntz").alias("last_execution"),
        )
    )
    joined = alerts.join(runs, "alert_id", "left")
    return joined.withColumn("executions", F.coalesce("executions", F.lit(0)).cast("long")).withColumn(
        "remediated", F.col("executions") > 0
    )
