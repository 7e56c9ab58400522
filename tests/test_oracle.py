"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import pytest
from oracle import difference, tables

from strataflow import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    if name in plans.SQL:
        assert difference(spark, con, plans.QUERIES[name], plans.SQL[name], SF) == ""
    else:
        assert plans.QUERIES[name](spark, SF).count() > 0
