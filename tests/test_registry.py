import os

import pytest

from tests.oracle import compare
from weft.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("WEFT_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_oracle(spark, name):
    compare(spark, SF, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
