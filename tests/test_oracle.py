"""Every query with SQL gives the SQL's rows on the smallest tables; the others run."""

import pytest

import __spark_entry__ as entry
from conftest import DATA, normal

CORE = {k: v for m in entry._CORE for k, v in __import__(m, fromlist=["x"]).QUERIES.items()}
SQL = {k: v for m in entry._CORE for k, v in __import__(m, fromlist=["x"]).SQL.items()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = entry._shipping(CORE[name])(spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in SQL:
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert rows == sorted((tuple(normal(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans_push_filters_and_prune_columns(spark):
    plan = CORE["filter_size_range"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(size), GreaterThanOrEqual(size,1024), LessThanOrEqual(size,4096)]" in plan
    assert "ReadSchema: struct<id:bigint,size:bigint>" in plan
