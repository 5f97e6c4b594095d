"""Every registered query beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import QUERIES

MAY_BE_EMPTY = {"extract_sha1", "extract_domain", "scan_logs_stream"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLE) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    problem = compare(spark, con, sf_dir, name)
    assert not problem or (problem == "no rows" and name in MAY_BE_EMPTY)


def test_entry_runs(spark):
    hits = entry_point.entry(spark)
    assert hits.count() > 0 and "database_id" in hits.columns
