import pytest

import __spark_entry__ as entry
from roadlake.oracle import ORACLE
from roadlake.queries import QUERIES
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(given):
    return connect(given)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, given, name):
    assert differences(spark, con, entry.queries()[name], ORACLE[name], given) is None


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert entry.queries().keys() >= QUERIES.keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
