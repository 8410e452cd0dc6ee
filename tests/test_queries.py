"""Every registered query against its SQL on the smallest driver tables, and its plan shape."""

import oracle
import pytest

import __spark_entry__ as entry

from marketreach.catalog.oracles import SQL
from marketreach.catalog.queries import REGISTRY as QUERIES

# a single scalar row joined by value needs no shuffle; nothing else may pair rows without a key
UNKEYED = ("CartesianProduct", "BroadcastNestedLoopJoin")
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in (*UNKEYED, *PYTHON)), name
    if name in SQL:
        assert oracle.differences(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0
