"""Queries over the test tables, one module per subject."""

import importlib

MODULES = [
    "flow_queries", "metric_queries", "alert_queries", "inventory_queries", "runbook_queries", "stream_queries",
]


def load():
    """Import every query module; return (queries, sql)."""
    from netweir.plans import registry

    for name in MODULES:
        importlib.import_module(f"netweir.plans.{name}")
    return registry.QUERIES, registry.SQL
