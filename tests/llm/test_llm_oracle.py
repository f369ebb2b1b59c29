"""Each training-data query that SQL can express equals its SQL."""

import pytest

from lakeloom.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    path = "/root/testdata/sf0.01"
    assert compare(queries.queries()[name](spark, path), queries.oracle_sql()[name], path) is None
