"""Every registered query with an SQL twin, side by side on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf, name):
    assert not compare(spark, con, sf, name).startswith("FAIL")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
