"""Every query against its SQL check; the others must give rows.

TEST_SF names the tables (the smallest set by default)."""

import os

import compare
import pytest

from threadlens.suite import ORACLES, QUERIES

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
if not os.path.isdir(SF):
    pytest.skip("test tables not found", allow_module_level=True)


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare.differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert sum(r["count"] for r in rows) > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
