import pytest

from tests.oracle import same
from textquarry.plans import queries, trees

QUERIES, ORACLE = queries.QUERIES | trees.QUERIES, queries.ORACLE | trees.ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE[name], "/root/testdata/sf0.001")
