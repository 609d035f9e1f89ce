import datetime as dt

import pytest

from netweir.operators import runbooks as rb

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


STEP = "array<struct<name:string,action:string>>"


@pytest.mark.parametrize(
    "name,approval,approvers,steps,reason",
    [
        ("ok", False, [], [("a", "wait")], ""),
        ("ok", True, ["eng"], [("a", "wait")], ""),
        ("", False, [], [("a", "wait")], rb.NO_NAME),
        ("ok", False, [], [], rb.NO_STEPS),
        ("ok", True, [], [("a", "wait")], rb.NO_APPROVERS),
        ("ok", False, [], [("a", "wait"), ("", "wait")], "step 1: name is required"),
        ("ok", False, [], [("a", "")], "step 0: action is required"),
        ("ok", False, [], [("a", ""), ("", "")], "step 0: action is required"),
    ],
)
def test_definitions(spark, name, approval, approvers, steps, reason):
    df = spark.createDataFrame(
        [(name, approval, approvers, steps)], f"name string, requires_approval boolean, approvers array<string>, steps {STEP}"
    )
    row = rb.validate_runbooks(df).first()
    assert (row.valid, row.reason) == (reason == "", reason)


def events(spark, *paths):
    rows = [(f"e{i}", at(60 * j), p) for i, path in enumerate(paths) for j, p in enumerate(path)]
    return spark.createDataFrame(rows, "execution string, ts timestamp, phase string")


def test_legal_paths(spark):
    df = events(
        spark, ["Pending", "Running", "Completed"],
        ["Pending", "PendingApproval", "Approved", "Running", "Failed", "RollingBack", "RolledBack"],
        ["Pending", "PendingApproval", "TimedOut"], ["Pending", "Running", "Failed", "RollingBack", "Failed", "RollingBack"],
    )
    assert rb.illegal_transitions(df).count() == 0


def test_terminal_phases_have_no_successor(spark):
    for end in ("Completed", "Cancelled", "TimedOut", "RolledBack"):
        df = events(spark, ["Pending", "Running"], [end, "Running"])
        got = {(r.previous_phase, r.phase) for r in rb.illegal_transitions(df).collect()}
        assert got == {(None, end), (end, "Running")}


def test_dwell(spark):
    got = {r.phase: r.dwell_seconds for r in rb.phase_dwell(events(spark, ["Pending", "Running", "Completed"])).collect()}
    assert got == {"Pending": 60.0, "Running": 60.0, "Completed": None}


def test_cooldown_is_strict(spark):
    rows = [("rb", "d", f"e{s}", at(s), "5m") for s in (0, 299, 599, 10_000)] + [("rb", "other", "x", at(1), "5m")]
    df = spark.createDataFrame(rows, "runbook string, device string, execution string, start_time timestamp, cooldown string")
    assert {(r.execution, r.previous_execution) for r in rb.cooldown_violations(df).collect()} == {("e299", "e0")}


def test_step_replay(spark):
    rows = [
        ("a", 0, False, False, None), ("a", 1, True, False, None), ("a", 2, False, False, None),
        ("b", 0, True, True, None), ("b", 1, False, False, "false"), ("b", 2, False, False, ""), ("b", 3, False, False, "true"),
        ("c", 0, True, False, "false"), ("c", 1, False, False, None),
    ]
    df = spark.createDataFrame(rows, "execution string, step_index bigint, failed boolean, continue_on_error boolean, condition string")
    got = {(r.execution, r.step_index): r.status for r in rb.step_outcomes(df).collect()}
    assert [got[k] for k in sorted(got)] == [
        "Completed", "Failed", "Skipped", "Failed", "Skipped", "Skipped", "Completed", "Skipped", "Completed",
    ]


def test_approval_timeout_default_is_one_hour(spark):
    rows = [("a", "PendingApproval", at(0), ""), ("b", "PendingApproval", at(0), "2h"), ("c", "Running", at(0), "")]
    df = spark.createDataFrame(rows, "execution string, phase string, created_at timestamp, approval_timeout string")
    got = rb.approval_timeouts(df, "2024-01-01 01:30:00").collect()
    assert [(r.execution, r.timed_out_at) for r in got] == [("a", at(3600))]


def test_namespace_defaults_to_the_executions_own(spark):
    ex = spark.createDataFrame([("e1", "rb", "", "ns1"), ("e2", "rb", "ns2", "ns1"), ("e3", "rb", "ns3", "ns1")],
                               "execution string, runbook string, ref_namespace string, namespace string")
    defs = spark.createDataFrame([("rb", "ns1", "one"), ("rb", "ns2", "two")], "runbook string, runbook_namespace string, kind string")
    assert {(r.execution, r.kind) for r in rb.with_runbook(ex, defs).collect()} == {("e1", "one"), ("e2", "two")}


def test_a_bad_pattern_is_the_problem_of_its_parameter(spark):
    runs = spark.createDataFrame([("e", "r", {"p": "abc", "q": "abc", "s": "xbc"})], "execution string, runbook string, parameters map<string,string>")
    rows = [("r", n, "string", False, "", p, []) for n, p in (("p", "a(b"), ("q", "^a"), ("s", "^a"))]
    declared = spark.createDataFrame(rows, "runbook string, parameter string, type string, required boolean, default_value string, validation string, options array<string>")
    got = {r.parameter: r.problem for r in rb.validate_parameters(runs, declared).collect()}
    assert got == {"p": "bad pattern", "q": "", "s": "does not match"}


def test_definitions_that_measure_large_are_not_broadcast(spark, monkeypatch):
    """Spark's guess of a small relation does not overrule the measured size."""
    monkeypatch.setattr("netweir.operators.joins.fits_broadcast", lambda df, max_bytes=0: False)
    runs = spark.createDataFrame([("e", "r1", {"p": "x"})], "execution string, runbook string, parameters map<string,string>")
    declared = spark.range(3).selectExpr(
        "concat('r', id) AS runbook", "'p' AS parameter", "'string' AS type", "false AS required",
        "'' AS default_value", "'' AS validation", "CAST(array() AS array<string>) AS options")
    found = rb.validate_parameters(runs, declared)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("e", "r1", "p", "x", "")]
