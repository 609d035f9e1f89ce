"""Physical plans: what has to hold for large inputs."""

import re

import pytest

from netweir.plans import load
from netweir.plans import metric_views as mv
from netweir.plans import views as v
from netweir.operators import panels
from netweir.operators import vectors as m
from netweir.operators.enrich import enrich

QUERIES, _ = load()
WRITES = ("stream_", "write_", "compact_", "expire_", "guarded_")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ancestors(text, leaf):
    """The operators between the scan that reads ``leaf`` and the root of the plan."""
    lines = text.splitlines()
    depth = lambda line: len(re.match(r"[ :|+\-]*", line).group())
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and leaf in line)
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    return above


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(WRITES)))
def test_no_product_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_enrichment_never_shuffles_flows(spark, sf_dir):
    flows = v.to_canonical(v.lineitem_wire(v.table(spark, sf_dir, "lineitem")))
    text = plan(enrich(flows, v.dimensions(spark, sf_dir)))
    spine = ancestors(text, "l_orderkey")
    joins = [line for line in spine if "Join" in line]
    assert len(joins) >= 10 and all("BroadcastHashJoin" in line for line in joins)
    assert not any("Exchange" in line for line in spine)


def test_top_k_is_one_aggregation_and_a_bounded_sort(spark, sf_dir):
    text = plan(panels.top_src_ips(v.flows(spark, sf_dir)))
    assert "TakeOrderedAndProject" in text and text.count("Exchange hashpartitioning") == 1


def test_top_k_per_time_trims_before_the_shuffle(spark, sf_dir):
    text = plan(m.topk(m.on_grid(mv.samples(spark, sf_dir, "up"), mv.STEP, mv.DAY), 5))
    assert "WindowGroupLimit" in text


def test_panels_read_only_their_columns(spark, sf_dir):
    text = plan(panels.top_protocols(v.flows(spark, sf_dir)))
    assert "ReadSchema: struct<l_linenumber:int,l_extendedprice:double>" in text


def test_range_functions_shuffle_panes_once_per_window_step(spark, sf_dir):
    text = plan(m.avg_over_time(mv.samples(spark, sf_dir, "up"), mv.DAY, mv.STEP))
    assert text.count("Exchange hashpartitioning") == 2
