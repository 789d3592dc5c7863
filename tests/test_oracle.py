"""Every registered query with a SQL twin gives the same rows in DuckDB."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, con, name):
    status, _, _, note = compare(spark, con, name, SF, oracle_sql()[name])
    assert status == "ok", note


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["dimension", "key", "n"]
