"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import os

import pytest

from nivalgrid.catalog import ORACLES, QUERIES
from tests.oracle import connect, run

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not mounted")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in ORACLES
    _, _, problem, _ = run(spark, con, name, SF, QUERIES, ORACLES)
    assert problem is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
