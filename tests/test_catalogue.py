import os

import pytest

from ravelin.plans.catalogue import ORACLE_SQL, QUERIES
from tests import compare

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.TABLES), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return compare.connect()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    compare.agrees(spark, QUERIES[name], ORACLE_SQL[name], con)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
