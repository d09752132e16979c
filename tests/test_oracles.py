"""Registered queries against their SQL twins."""

import pytest
from conftest import rows_of

from mateframe import registry

SQL = registry.oracle_sql()
#: Of the slower ones, pytest runs a few; the driver runs all.
SKIP = {"c1_orbit", "c10_encode_v2", "c28_mirror", "c17_square_features", "c25_adjacency", "c20_channels_five", "c11_encode_five"}


@pytest.mark.parametrize("name", sorted(SQL.keys() - SKIP))
def test_same_rows(spark, sf, oracle, name):
    assert rows_of(registry.queries()[name](spark, sf).toPandas()) == rows_of(oracle.execute(SQL[name]).df())
