"""The queries run on the smallest tables; those with SQL give its rows."""

import pytest

from conftest import DATA
from fernweh.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in Q.SQL:
        rel = duck.sql(Q.SQL[name])
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, rows), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    else:
        assert rows
