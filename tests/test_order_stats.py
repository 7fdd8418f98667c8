"""Order statistics: the narrowing search against sorting, on values chosen to be awkward."""

from __future__ import annotations

import numpy as np
import pytest

from trustframe.operators.order_stats import exact_median, kth_smallest, lower_median, select_ranks
from trustframe.operators.order_stats import with_counted_median
from trustframe.operators.rank import first_k, range_row_number, running_total, smallest_limit, spread_row_number
from pyspark.sql import Window, functions as F


def _values():
    rng = np.random.default_rng(5)
    hot = np.concatenate([rng.normal(0, 1, 400), np.zeros(150), rng.uniform(1e8, 1e8 + 1, 300), [-1e300, 1e300, 5e-324, np.inf]])
    return {
        "hot": hot,
        "ties": np.repeat([-2.0, -2.0, 3.5], 40),
        "one": np.array([7.25]),
        "even": np.array([4.0, 1.0, 3.0, 2.0]),
        "narrow": 1.0 + rng.integers(0, 5000, 900) * 2.0**-50,
        "negative": -np.exp(rng.normal(0, 20, 301)),
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(key, float(v)) for key, values in _values().items() for v in values]
    rows += [("even", None), ("even", float("nan"))]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


@pytest.mark.parametrize("direct_rows", [1_000_000, 50, 3])
def test_medians_match_numpy(table, direct_rows):
    got = {r["k"]: r for r in exact_median(table, ["k"], "v", direct_rows=direct_rows).collect()}
    low = {r["k"]: r["median"] for r in lower_median(table, ["k"], "v", direct_rows=direct_rows).collect()}
    for key, values in _values().items():
        assert got[key]["n"] == len(values)
        assert got[key]["median"] == np.median(values), key
        assert low[key] == np.sort(values)[(len(values) - 1) // 2], key


@pytest.mark.parametrize("direct_rows", [1_000_000, 50, 3])
def test_counted_values_have_the_medians_of_all_values(table, direct_rows):
    counted = table.groupBy("k", "v").agg(F.count("*").alias("times"))
    got = {r["k"]: r["median"] for r in exact_median(counted, ["k"], "v", direct_rows=direct_rows, weight="times").collect()}
    assert got == {key: np.median(values) for key, values in _values().items()}
    beside = with_counted_median(counted, ["k"], "v", "times", "m").select("k", "m").distinct().collect()
    assert {r["k"]: r["m"] for r in beside} == got


@pytest.mark.parametrize("step", [1 << 20, 16, 3])
def test_running_totals_in_blocks(spark, step):
    rows = spark.range(500).select((F.col("id") * 7 - 300).alias("at"), (F.col("id") % 3).alias("k"), (F.col("id") % 11).alias("n"))
    for keys in ([], ["k"]):
        found = running_total(rows, keys, "at", "n", "upto", step)
        plain = F.sum("n").over(Window.partitionBy(*keys).orderBy("at"))
        assert found.count() == 500 and found.withColumn("plain", plain).where("upto <> plain").isEmpty()
    assert running_total(rows.limit(0), [], "at", "n", "upto", step).count() == 0


def test_range_row_numbers(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    found = range_row_number(rows, ["k"], ["v"], "rn")
    plain = F.row_number().over(Window.partitionBy("k").orderBy("v"))
    assert found.count() == 2000 and found.withColumn("plain", plain).where("rn <> plain").isEmpty()


@pytest.mark.parametrize("direct_rows", [1_000_000, 10])
def test_ranks_without_keys(table, direct_rows):
    everything = np.sort(np.concatenate(list(_values().values())))
    ranks = lambda n: {"first": F.lit(1).cast("long"), "tenth": F.floor(n / 10).cast("long"), "last": n}
    row = select_ranks(table, [], "v", ranks, direct_rows=direct_rows).collect()[0]
    assert row["n"] == len(everything)
    assert row["first"] == everything[0]
    assert row["tenth"] == everything[len(everything) // 10 - 1]
    assert row["last"] == everything[-1]


@pytest.mark.parametrize("hex_digits", [1, 2, 4])
def test_spread_row_number_equals_plain_window(spark, hex_digits):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k")
    ).withColumn("d", F.md5(F.col("id").cast("string").cast("binary")))
    ranked = spread_row_number(rows, ["k"], "d", ["id"], hex_digits=hex_digits)
    plain = F.row_number().over(Window.partitionBy("k").orderBy("d", "id"))
    assert ranked.withColumn("plain", plain).where("rn <> plain").count() == 0
    assert ranked.count() == 3000


def test_first_k_is_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("k"))
    limited = first_k(rows, ["k"], [F.col("id").desc()], 3)
    assert sorted(r["id"] for r in limited.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in limited._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [1, 7, 60, 5000])
def test_limits_of_the_smallest(spark, k):
    rows = spark.range(400).select(
        (F.col("id") % 3 % 2).alias("k"), (F.col("id") % 5).cast("double").alias("v"), (F.col("id") * 7919 % 1009).alias("t")
    )
    rows = rows.withColumn("t", F.xxhash64("t"))  # ids of all 64 bits, more than a double can tell apart
    expected = {}
    for r in rows.collect():
        expected.setdefault(r["k"], []).append((r["v"], r["t"]))
    expected = {key: sorted(v)[min(k, len(v)) - 1] for key, v in expected.items()}
    for group_limit in (0, 1000) if k <= 1000 else (0,):
        got = {r["k"]: tuple(r["_limit"]) for r in smallest_limit(rows, ["k"], "v", "t", k, group_limit).collect()}
        assert got == expected
    assert kth_smallest(rows, ["k"], "v", "t", k, direct_rows=2).count() == 2
