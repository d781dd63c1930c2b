"""Every query of the core against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

from sporlake import catalogue, catalogue_records, catalogue_records_sql, catalogue_sql, catalogue_text, catalogue_text_sql, problems, problems_sql

QUERIES = catalogue.QUERIES | catalogue_records.QUERIES | catalogue_text.QUERIES | problems.QUERIES
SQL = catalogue_sql.SQL | catalogue_records_sql.SQL | catalogue_text_sql.SQL | problems_sql.SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, sf, name):
    assert differences(spark, con, name, QUERIES[name], SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
