"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import oracle
import pytest

from convoy.plans import catalog

SF = os.environ.get("CONVOY_TEST_TABLES", "/root/testdata/sf0.001")
#: Approximate by nature; ``approx_tenants_error`` checks its bound.
NO_SQL = {"approx_tenants"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert name in NO_SQL and catalog.queries()[name](spark, SF).count() > 0
    else:
        assert oracle.compare(spark, con, name, SF, catalog.queries()[name], sql) == ""


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
