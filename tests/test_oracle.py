"""Every registered query against its DuckDB oracle (t2), and the
rows-only queries for a stable, non-empty result (t1)."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF0001, SF001
from oracle import compare, duck

SQL = E.oracle_sql()
QUERIES = E.queries()
#: Queries with tests of their own.
OWN = {n for n in QUERIES if re.match("op[0-9]+_|pipeline", n)}


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_a_builder():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    err = compare(spark, con, name, QUERIES[name], SQL[name], SF001)
    assert err is None, err


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - OWN))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF0001)
    assert df.count() > 0
    assert df.schema == QUERIES[name](spark, SF0001).schema


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 16
    assert [f.name for f in df.schema.fields] == ["y", "x", "n", "r2"]
