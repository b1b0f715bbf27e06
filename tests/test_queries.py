"""Every registered query against its SQL on the smallest tables, and what its plan may contain."""

from __future__ import annotations

import os

import pytest
from oracle import connect, difference

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
OTHERS = entry._training_text()[0]
QUERIES = {name: query for name, query in entry.queries().items() if name not in OTHERS}
SQLS = {name: sql for name, sql in entry.oracle_sql().items() if name not in OTHERS}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(QUERIES)
    assert set(QUERIES) == set(SQLS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    if name in SQLS:
        assert difference(df, con, SQLS[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    hits = entry.entry(spark)
    assert hits.columns[:3] == ["request_id", "rank", "product_id"]
    assert hits.count() > 0
