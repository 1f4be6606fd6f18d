"""The registered queries against their SQL."""

import pytest
from oracle import compare, connect

from chartloom.llm import registry


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    assert compare(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.ORACLE_SQL[name]) is None
