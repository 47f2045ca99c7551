import pytest

from tests.oracle import compare
from weft.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    compare(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLE_SQL[name])
