"""Queries of the subpackage against their SQL twins on the smallest tables, and that all of them run."""

import os

import pytest

from tests.test_queries import DIR, plain
from trovelle.llm import queries as Q


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_twin(spark, duck, name):
    df, sql = Q.queries()[name](spark, DIR), duck.sql(Q.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    place = [sql.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.toArrow().to_pylist()) == sorted(tuple(plain(r[i]) for i in place) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, duck, name):
    assert Q.queries()[name](spark, DIR).count() > 0
