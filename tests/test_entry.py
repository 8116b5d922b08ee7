import pytest

import __spark_entry__ as entry
from compare import compare
from ledgerloom.plans import queries as base

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, SF, base.QUERIES[name], base.SQL[name])


@pytest.mark.parametrize("name", sorted({*base.QUERIES} - {*base.SQL}))
def test_query_without_sql_runs(spark, name):
    assert base.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert {*entry.oracle_sql()} <= {*entry.queries()} and {*base.QUERIES} <= {*entry.queries()}


def test_names_of_queries_are_given_once():
    from ledgerloom.plans.registry import QUERIES, query

    with pytest.raises(ValueError, match="already"):
        query()(QUERIES["effective_status"])
