import pytest

from lakeloom.plans import catalogue
from tests.oracle import compare

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df, sql = catalogue.queries()[name](spark, PATH), catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, sql, PATH) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
