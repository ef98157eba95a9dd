"""Every query with a SQL check, side by side on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from conftest import SMALL
from lagline import catalog

# The document queries have their own tests.
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_check_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLE[name]).df()) == "ok"
