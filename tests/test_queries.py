import pytest
from oracle import same

from millrace.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_as_sql(spark, name):
    same(spark, name, queries()[name], oracle_sql()[name])
