from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from embedmap.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", master="local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def scratch():
    """A fresh folder per test."""
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(df, *order):
    """Collected rows as sorted tuples."""
    return sorted(tuple(r) for r in df.select(*(order or df.columns)).collect())


def broadcasts(df) -> list[str]:
    """Runs a query; the plans of what it broadcast."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
        if name == "BroadcastExchange":
            found.append(node.toString())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found
