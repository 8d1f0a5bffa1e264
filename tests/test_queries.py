"""Every registered query runs, and equals its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as E
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, con, name):
    verdict = compare(spark, con, name, FOLDER)[2]
    assert verdict.startswith(("ok", "no SQL")), verdict


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
