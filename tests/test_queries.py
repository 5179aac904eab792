"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import re

import pytest
from compare import check, connect

import __spark_entry__ as entry

# the training-data operators have tests of their own
QUERIES = {n: q for n, q in entry.queries().items() if n != "pipeline" and not re.match(r"op\d+_", n)}
SQL = {n: sql for n, sql in entry.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) == set(entry.ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf, name):
    problem, n = check(spark, duck, sf, name, QUERIES[name], SQL.get(name))
    assert problem is None, problem
    assert n > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "work_id" and df.limit(1).count() == 1
