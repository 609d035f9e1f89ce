import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edge_rows import EDGE  # noqa: E402

from netweir.llm.common import reachable  # noqa: E402


@pytest.fixture(autouse=True)
def workers(spark):
    reachable(spark)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge rows with columns that operators use for themselves."""
    rows = [(i, t, "score", 1, 2, 3.0, "x") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score int, id long, component double, length string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, extra string")
