import pytest
from oracle import SMALL, assert_same

from tracemill.plans import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLE[name])
