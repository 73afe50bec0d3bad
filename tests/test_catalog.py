"""Every query of the catalog against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from tests.oracle import connect, difference
from verdictflow.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert difference(df, con, sql) == ""
