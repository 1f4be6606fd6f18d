import pytest
from oracle import compare, connect

from chartloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert compare(df, con, catalog.ORACLE_SQL[name]) is None
    else:
        assert df.collect() is not None
