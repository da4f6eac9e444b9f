"""Every registered query against its SQL, and what its plan may not hold."""

import pytest

import __spark_entry__ as entry
from checks.compare import multiset
from checks.registry import ORACLE, QUERIES

NAMES = sorted(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    rows = df.collect()
    assert rows
    sql = ORACLE.get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert multiset(df.columns, rows) == multiset(columns, cursor.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1808


def test_only_the_approximate_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE) == {"inner_product_topk_approx", "inner_product_topk_cells"}
    assert set(QUERIES) <= set(entry.queries())
