"""The package's queries as the driver finds them, and those with SQL against it."""

from __future__ import annotations

import pytest
from compare import compare, duck

from __spark_entry__ import oracle_sql, queries
from trustframe.llm import catalog

SF = "/root/testdata/sf0.01"


def test_all_are_registered():
    names = [name for name in queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert set(catalog.QUERIES) <= set(queries()) and "pipeline" in queries()
    assert set(catalog.ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    rows, message = compare(spark, duck(SF), catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert rows and message == ""
