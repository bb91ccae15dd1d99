"""Every query of the core against its SQL on the smallest tables, and the rest for running."""

from __future__ import annotations

import oracle
import pytest

from siftwire.plans import queries as core

SQL, QUERIES = core.oracle_sql(), core.queries()


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, con, name):
    assert oracle.difference(QUERIES[name](spark, data), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, data):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["content_hash", "id", "members"]
    assert set(e.oracle_sql()) <= set(e.queries())
