import pytest

from tests.oracle import compare
from tessel.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name]) > 0
