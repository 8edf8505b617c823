"""Every query with an SQL twin gives the same rows."""

import os

import pytest

from corpusmill import catalogue
from tests.oracle import connection, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, con, name):
    assert difference(catalogue.queries()[name](spark, FOLDER), catalogue.oracle_sql()[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_sql_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0
