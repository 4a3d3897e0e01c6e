"""Every registered query of the library gives DuckDB's rows."""

import os

import pytest

from dbpulse.queries import ORACLE_SQL, QUERIES, load
from tests.compare import SF, same

load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name])
