"""Remediation-history queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweir.functions.labels import label
from netweir.functions.timing import duration_seconds
from netweir.operators import runbooks as rb
from netweir.plans import alert_queries as aq
from netweir.plans import metric_views as mv
from netweir.plans import views as v
from netweir.plans.registry import query
from netweir.plans.views_sql import VIEWS, sql
from netweir.session import work_dir
from netweir.sources.tables import read_audit

TIMEOUTS = ["1h", "30m", "1h30m", "", "90s"]
COOLDOWNS = ["15m", "240h", "720h"]
SOURCES = {"1-URGENT": "alert", "2-HIGH": "manual", "3-MEDIUM": "scheduled"}
AS_OF = "1998-06-01 00:00:00"


# ------------------------------------------------------------ views


def executions(spark, sf):
    """Orders as executions: the customer is the runbook, priority the trigger, status the phase."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    seconds = lambda n: F.make_dt_interval(secs=n)
    created = F.col("o_orderdate").cast("timestamp") + seconds(k % 86_400)
    source = F.lit("api")
    for priority, name in SOURCES.items():
        source = F.when(F.col("o_orderpriority") == priority, name).otherwise(source)
    return v.table(spark, sf, "orders").select(
        F.concat(F.lit("exec-"), k.cast("string")).alias("execution"),
        F.concat(F.lit("ns"), (k % 3).cast("string")).alias("namespace"),
        F.concat(F.lit("rb"), cust.cast("string")).alias("runbook"),
        F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("ns"), (cust % 3).cast("string"))).alias("ref_namespace"),
        F.concat(F.lit("r"), (k % 4).cast("string")).alias("device"),
        source.alias("trigger_source"),
        F.when(source == "alert", F.concat(F.lit("DeviceUnreachable/r"), cust.cast("string"))).otherwise("").alias("alert_ref"),
        F.when(F.col("o_orderstatus") == "P", "PendingApproval").when(F.col("o_orderstatus") == "F", "Failed")
        .otherwise("Completed").alias("phase"),
        created.alias("created_at"),
        created.alias("start_time"),
        F.when(F.col("o_orderstatus") != "P", created + seconds(k * 7 % 5000 + 0.25)).alias("completion_time"),
        F.element_at(F.array(*[F.lit(x) for x in TIMEOUTS]), (cust % 5 + 1).cast("int")).alias("approval_timeout"),
        F.element_at(F.array(*[F.lit(x) for x in COOLDOWNS]), (cust % 3 + 1).cast("int")).alias("cooldown"),
        F.create_map(
            F.lit("device"), F.concat(F.lit("r"), (k % 4).cast("string")),
            F.lit("neighbor_address"), F.when(k % 5 == 0, "10.0.0").otherwise(F.concat(F.lit("10.0.0."), (k % 250).cast("string"))),
            F.lit("count"), F.when(k % 7 == 0, "many").otherwise((k % 9).cast("string")),
            F.lit("mode"), F.when(k % 11 == 0, "odd").when(k % 3 == 0, "hard").otherwise("soft"),
            F.lit("dry"), F.when(k % 13 == 0, "maybe").otherwise("TRUE"),
        ).alias("parameters"),
    )


VIEWS["v_exec"] = f"""
  SELECT 'exec-' || o_orderkey AS execution, 'ns' || (o_orderkey % 3) AS namespace, 'rb' || o_custkey AS runbook,
      CASE WHEN o_orderkey % 2 = 0 THEN 'ns' || (o_orderkey % 3) ELSE 'ns' || (o_custkey % 3) END AS runbook_namespace,
      'r' || (o_orderkey % 4) AS device, o_orderkey AS k, o_custkey AS c,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'alert' WHEN '2-HIGH' THEN 'manual' WHEN '3-MEDIUM' THEN 'scheduled'
          ELSE 'api' END AS trigger_source,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'DeviceUnreachable/r' || o_custkey ELSE '' END AS alert_ref,
      CASE o_orderstatus WHEN 'P' THEN 'PendingApproval' WHEN 'F' THEN 'Failed' ELSE 'Completed' END AS phase,
      o_orderdate + to_seconds(o_orderkey % 86400) AS created_at,
      CASE WHEN o_orderstatus != 'P' THEN o_orderkey * 7 % 5000 END AS duration_s,
      [3600, 1800, 5400, 3600, 90][o_custkey % 5 + 1] AS timeout_s,
      [900, 864000, 2592000][o_custkey % 3 + 1] AS cooldown_s
  FROM orders"""


def definitions(spark, sf):
    """Customers as runbooks that executions refer to; parts as runbooks to validate."""
    c = F.col("c_custkey")
    return v.table(spark, sf, "customer").select(
        F.concat(F.lit("rb"), c.cast("string")).alias("runbook"),
        F.concat(F.lit("ns"), (c % 3).cast("string")).alias("runbook_namespace"),
        F.col("c_mktsegment").alias("category"),
        (c % 2 == 0).alias("requires_approval"),
    )


def part_runbooks(spark, sf):
    p, size = F.col("p_partkey"), F.col("p_size")
    step = lambda i: F.struct(
        F.when((p + i) % 11 == 0, "").otherwise(F.concat(F.lit("step-"), i.cast("string"))).alias("name"),
        F.when((p + i) % 13 == 0, "").otherwise("gnmi_get").alias("action"),
    )
    return v.table(spark, sf, "part").select(
        p.alias("id"),
        F.when(size % 9 == 0, "").otherwise(F.col("p_name")).alias("name"),
        (size % 2 == 0).alias("requires_approval"),
        F.when(size % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("network-engineers"))).alias("approvers"),
        F.when(size % 5 == 0, F.array().cast("array<struct<name:string,action:string>>")).otherwise(
            F.transform(F.sequence(F.lit(0), (size % 5).cast("int")), step)
        ).alias("steps"),
    )


def phase_events(spark, sf):
    """Line items as phase changes of their order."""
    phases = ["Pending", "PendingApproval", "Approved", "Running", "Completed", "Failed", "RollingBack"]
    return v.table(spark, sf, "lineitem").select(
        F.concat(F.lit("exec-"), F.col("l_orderkey").cast("string")).alias("execution"),
        (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(secs=F.col("l_partkey") % 86_400)).alias("ts"),
        F.element_at(F.array(*[F.lit(p) for p in phases]), F.col("l_linenumber")).alias("phase"),
    )


VIEWS["v_phase"] = """
  SELECT 'exec-' || l_orderkey AS execution, l_shipdate + to_seconds(l_partkey % 86400) AS ts,
      ['Pending', 'PendingApproval', 'Approved', 'Running', 'Completed', 'Failed', 'RollingBack'][l_linenumber] AS phase
  FROM lineitem"""


# ------------------------------------------------------------ definitions


@query("runbook_validation", sql("""
    WITH s AS (SELECT p_partkey AS id, i, CASE WHEN (p_partkey + i) % 11 = 0 THEN 'name is required'
            WHEN (p_partkey + i) % 13 = 0 THEN 'action is required' END AS problem
        FROM part, generate_series(0, 4) AS g(i) WHERE p_size % 5 != 0 AND i <= p_size % 5),
    f AS (SELECT id, arg_min('step ' || i || ': ' || problem, i) AS problem FROM s WHERE problem IS NOT NULL GROUP BY id),
    r AS (SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 OR p_name = '' THEN 'runbook name is required'
        WHEN p_size % 5 = 0 THEN 'runbook must have at least one step'
        WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'approvers required when requiresApproval is true'
        ELSE coalesce(f.problem, '') END AS reason FROM part LEFT JOIN f ON p_partkey = f.id)
    SELECT id, reason = '' AS valid, reason FROM r"""))
def runbook_validation(spark, sf):
    return rb.validate_runbooks(part_runbooks(spark, sf)).select("id", "valid", "reason")


_ADDRESS = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def parameter_definitions(spark, sf):
    """Six parameters for every runbook."""
    rows = [
        ("device", "device", True, "", "", []),
        ("neighbor_address", "string", True, "", _ADDRESS, []),
        ("network_instance", "string", False, "default", "", []),
        ("count", "integer", False, "3", "", []),
        ("mode", "select", False, "soft", "", ["soft", "hard"]),
        ("dry", "boolean", False, "false", "", []),
        ("ticket", "string", True, "", "", []),
    ]
    one = lambda r: F.struct(
        F.lit(r[0]).alias("parameter"), F.lit(r[1]).alias("type"), F.lit(r[2]).alias("required"),
        F.lit(r[3]).alias("default_value"), F.lit(r[4]).alias("validation"),
        F.array(*[F.lit(o) for o in r[5]]).cast("array<string>").alias("options"),
    )
    runbook = F.concat(F.lit("rb"), F.col("c_custkey").cast("string")).alias("runbook")
    return v.table(spark, sf, "customer").select(runbook, F.explode(F.array(*[one(r) for r in rows])).alias("d")).select(
        "runbook", "d.*"
    )


@query("param_validation", sql("""
    SELECT execution, runbook, parameter, value, problem FROM (
      SELECT execution, runbook, unnest([
        {parameter: 'device', value: 'r' || (k % 4), problem: ''},
        {parameter: 'neighbor_address', value: CASE WHEN k % 5 = 0 THEN '10.0.0' ELSE '10.0.0.' || (k % 250) END,
         problem: CASE WHEN k % 5 = 0 THEN 'does not match' ELSE '' END},
        {parameter: 'network_instance', value: 'default', problem: ''},
        {parameter: 'count', value: CASE WHEN k % 7 = 0 THEN 'many' ELSE CAST(k % 9 AS VARCHAR) END,
         problem: CASE WHEN k % 7 = 0 THEN 'not an integer' ELSE '' END},
        {parameter: 'mode', value: CASE WHEN k % 11 = 0 THEN 'odd' WHEN k % 3 = 0 THEN 'hard' ELSE 'soft' END,
         problem: CASE WHEN k % 11 = 0 THEN 'not an option' ELSE '' END},
        {parameter: 'dry', value: CASE WHEN k % 13 = 0 THEN 'maybe' ELSE 'TRUE' END,
         problem: CASE WHEN k % 13 = 0 THEN 'not a boolean' ELSE '' END},
        {parameter: 'ticket', value: NULL, problem: 'missing'}], recursive := true)
      FROM v_exec WHERE c IN (SELECT c_custkey FROM customer))"""))
def param_validation(spark, sf):
    return rb.validate_parameters(executions(spark, sf), parameter_definitions(spark, sf))


@query("audit_timeline", sql("""
    SELECT 'ns' AS namespace, execution, row_number() OVER w AS position, 'Phase' || phase AS event_type, ts AS at,
        (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0E0 AS seconds_since
    FROM v_phase WINDOW w AS (PARTITION BY execution ORDER BY ts, 'Phase' || phase)"""))
def audit_timeline(spark, sf):
    """Phase changes written as an audit log and read back, event by event."""
    log = phase_events(spark, sf).select(
        F.col("ts").alias("timestamp"), F.concat(F.lit("Phase"), "phase").alias("eventType"),
        F.col("execution").alias("executionName"), F.lit("ns").alias("namespace"), F.lit("").alias("stepName"),
    )
    path = work_dir(spark, "audit")
    log.write.json(path)
    return v.printable(rb.timeline(read_audit(spark, path)))


@query("duration_seconds", sql("""
    SELECT execution, approval_timeout, CAST(timeout_s AS DOUBLE) AS timeout_s, CAST(cooldown_s AS DOUBLE) AS cooldown_s
    FROM (SELECT *, ['1h', '30m', '1h30m', '', '90s'][c % 5 + 1] AS approval_timeout FROM v_exec)"""))
def q_duration_seconds(spark, sf):
    return executions(spark, sf).select(
        "execution", "approval_timeout",
        duration_seconds(F.col("approval_timeout"), rb.APPROVAL_TIMEOUT_S).alias("timeout_s"),
        duration_seconds(F.col("cooldown")).alias("cooldown_s"),
    )


# ------------------------------------------------------------ executions


@query("execution_runbook", sql("""
    SELECT execution, runbook, runbook_namespace, c_mktsegment AS category, c_custkey % 2 = 0 AS requires_approval
    FROM v_exec JOIN customer ON runbook = 'rb' || c_custkey AND runbook_namespace = 'ns' || (c_custkey % 3)"""))
def execution_runbook(spark, sf):
    joined = rb.with_runbook(executions(spark, sf), definitions(spark, sf))
    return joined.select("execution", "runbook", "runbook_namespace", "category", "requires_approval")


_LEGAL = " OR ".join(
    f"(p = '{source}' AND phase IN ({', '.join(repr(t) for t in targets)}))" for source, targets in rb.TRANSITIONS.items()
)


@query("illegal_transitions", sql(f"""
    SELECT execution, p AS previous_phase, phase, ts FROM (
      SELECT *, lag(phase) OVER (PARTITION BY execution ORDER BY ts, phase) AS p FROM v_phase)
    WHERE NOT coalesce((p IS NULL AND phase = 'Pending') OR {_LEGAL}, false)"""))
def illegal_transitions(spark, sf):
    return rb.illegal_transitions(phase_events(spark, sf))


@query("phase_dwell", sql("""
    SELECT execution, phase, ts AS entered_at,
        (epoch_us(lead(ts) OVER (PARTITION BY execution ORDER BY ts, phase)) - epoch_us(ts)) / 1000000.0E0 AS dwell_seconds
    FROM v_phase"""))
def phase_dwell(spark, sf):
    return rb.phase_dwell(phase_events(spark, sf))


@query("cooldown_violations", sql("""
    SELECT runbook, device, execution, previous_execution, gap_seconds FROM (
      SELECT *, lag(execution) OVER w AS previous_execution,
        (epoch_us(created_at) - epoch_us(lag(created_at) OVER w)) / 1000000.0E0 AS gap_seconds
      FROM v_exec WINDOW w AS (PARTITION BY runbook, device ORDER BY created_at, execution))
    WHERE gap_seconds < cooldown_s"""))
def cooldown_violations(spark, sf):
    return rb.cooldown_violations(executions(spark, sf))


def steps(spark, sf):
    """Line items as steps: a returned line failed, an open one continues on error."""
    return v.table(spark, sf, "lineitem").select(
        F.concat(F.lit("exec-"), F.col("l_orderkey").cast("string")).alias("execution"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("step_index"),
        (F.col("l_returnflag") == "R").alias("failed"),
        (F.col("l_linestatus") == "O").alias("continue_on_error"),
        F.when(F.col("l_tax") == 0, "false").when(F.col("l_discount") == 0, "").alias("condition"),
    )


@query("step_outcomes", sql("""
    WITH s AS (SELECT 'exec-' || l_orderkey AS execution, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS step_index,
        l_returnflag = 'R' AS failed, l_linestatus = 'O' AS continue_on_error,
        CASE WHEN l_tax = 0 THEN 'false' WHEN l_discount = 0 THEN '' END AS condition FROM lineitem)
    SELECT *, CASE WHEN coalesce(bool_or(failed AND NOT continue_on_error AND condition IS NULL) OVER (
            PARTITION BY execution ORDER BY step_index RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
          OR condition IS NOT NULL THEN 'Skipped' WHEN failed THEN 'Failed' ELSE 'Completed' END AS status FROM s"""))
def step_outcomes(spark, sf):
    return rb.step_outcomes(steps(spark, sf))


@query("execution_kpis", sql("""
    SELECT phase, trigger_source, count(*) AS executions, avg(duration_s) AS avg_duration_s,
        quantile_cont(duration_s, 0.5) AS median_duration_s, max(duration_s) AS max_duration_s
    FROM v_exec GROUP BY ALL"""))
def execution_kpis(spark, sf):
    return rb.execution_kpis(executions(spark, sf))


@query("pending_approvals", sql("""
    SELECT runbook, count(*) AS pending, min(created_at) AS oldest FROM v_exec WHERE phase = 'PendingApproval'
    GROUP BY runbook"""))
def pending_approvals(spark, sf):
    return rb.pending_approvals(executions(spark, sf))


@query("approval_timeouts", sql(f"""
    SELECT execution, CAST(timeout_s AS DOUBLE) AS timeout_s, 'TimedOut' AS phase,
        created_at + to_seconds(timeout_s) AS timed_out_at
    FROM v_exec WHERE phase = 'PendingApproval' AND created_at + to_seconds(timeout_s) < TIMESTAMP '{AS_OF}'"""))
def approval_timeouts(spark, sf):
    return rb.approval_timeouts(executions(spark, sf), AS_OF)


@query("alert_remediation", sql(f"""
    WITH a AS (SELECT *, alertname || '/' || {mv.label_sql('instance')} AS alert_id FROM v_intervals_DeviceUnreachable),
    r AS (SELECT alert_ref AS alert_id, count(*) AS executions, min(created_at) AS first_execution,
        max(created_at) AS last_execution FROM v_exec WHERE alert_ref != '' GROUP BY ALL)
    SELECT alert_id, active_at, coalesce(executions, 0) AS executions, first_execution, last_execution,
        coalesce(executions, 0) > 0 AS remediated FROM a LEFT JOIN r USING (alert_id)"""))
def alert_remediation(spark, sf):
    found = aq.intervals_of(spark, sf, ["DeviceUnreachable"])
    alerts = found.select(
        F.concat("alertname", F.lit("/"), label(F.col("series_key"), "instance")).alias("alert_id"), "active_at"
    )
    return rb.remediation(alerts, executions(spark, sf))
