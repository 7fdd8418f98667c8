"""Every registered query against its SQL, over the whole smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from trustframe.catalog import all_oracles, all_queries

SF_DIR = "/root/testdata/sf0.001"
ROWS_ONLY = {"local_mlp", "baseline_binary", "baseline_multiclass"}


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql_or_is_known_to_have_none():
    assert set(oracle_sql()) <= set(queries())
    assert set(all_queries()) - set(all_oracles()) == ROWS_ONLY
    assert set(all_queries()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, connection, name):
    rows, message = compare(spark, connection, all_queries()[name], all_oracles().get(name), SF_DIR)
    assert message == ""
    assert rows > 0
