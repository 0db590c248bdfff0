"""Every query runs at the smallest scale and, where there is SQL for it, gives the same rows."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_check_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["file_audit", "upload_audit", "severity_model_cv"])
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
