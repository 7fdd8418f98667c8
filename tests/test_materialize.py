"""Summary tables above their limits: written, measured, and joined without a broadcast when too large."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trustframe.operators import materialize
from trustframe.operators.materialize import Settled, join_checked, measured_bytes, settle


def test_small_and_written_tables_join_alike(spark, monkeypatch):
    large = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 10).alias("k"))
    table = spark.range(10).select(F.col("id").alias("k"), F.array(F.col("id") * 1.5, F.lit(2.0)).alias("v"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    literal = settle(table)
    assert literal.small and "LocalTableScan" in plan(literal.df)
    written = settle(table, max_rows=3)
    assert written.small and "LocalTableScan" not in plan(written.df)
    monkeypatch.setattr(materialize, "BROADCAST_LIMIT_BYTES", 10)
    too_large = settle(table, max_rows=3)
    assert not too_large.small and measured_bytes(too_large.df) > 10
    rows = lambda settled, how: sorted((r["id"], tuple(r["v"] or ())) for r in join_checked(large, settled, ["k"], how).collect())
    for how in ("inner", "left"):
        assert rows(literal, how) == rows(written, how) == rows(too_large, how)
    assert "BroadcastHashJoin" in plan(join_checked(large, written, ["k"]))
    assert "BroadcastHashJoin" not in plan(join_checked(large, too_large, ["k"]))
    assert "SortMergeJoin" in plan(join_checked(large, too_large, ["k"]))
    with pytest.raises(ValueError, match="needs a small table"):
        join_checked(large, too_large, [])
    derived = too_large.derive(too_large.df.drop("v"))
    assert isinstance(derived, Settled) and not derived.small
