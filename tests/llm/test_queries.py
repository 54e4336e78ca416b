import os

import pytest

from ravelin.llm.queries import ORACLE_SQL, QUERIES
from tests import compare

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.TABLES), reason="no test tables here")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare.agrees(spark, QUERIES[name], ORACLE_SQL[name], compare.connect())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_result_is_distinct(spark, name):
    got = QUERIES[name](spark, compare.TABLES)
    assert got.count() == got.distinct().count()
