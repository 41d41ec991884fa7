"""The queries of this subpackage against their SQL on the smallest tables."""

from __future__ import annotations

import os

import oracle
import pytest

from convoy.llm import catalog

SF = os.environ.get("CONVOY_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    sql, query = catalog.oracle_sql().get(name), catalog.queries()[name]
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        assert oracle.compare(spark, oracle.connect(SF), name, SF, query, sql) == ""
