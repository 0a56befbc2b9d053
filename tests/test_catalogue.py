"""Queries against their SQL at the smallest scale.

All queries of the catalogue run; those of the text operators have tests of their own.
``python -m tests.oracle_check`` runs any of them at any scale.
"""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalogue import queries as catalogue_queries
from tests.oracle_check import connect, differences

SF_DIR = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(catalogue_queries.ALL))
def test_query_agrees_with_sql(spark, duck, name):
    found = queries()[name](spark, SF_DIR).toPandas()
    assert len(found)
    if name in oracle_sql():
        assert differences(found, duck.execute(oracle_sql()[name]).df()) == []


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 4
