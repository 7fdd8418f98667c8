"""Partitioning: exact sizes, disjoint clients, and results that do not depend on how rows are laid out."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from trustframe.functions.hashing import keyed_uniform
from trustframe.operators import noise, partition

FAMILIES = ["normal", "dos", "probe", "r2l", "u2r"]


def pool(spark, n, skew=None):
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("id") % 5 + 1).cast("int"))
    if skew:
        family = F.when(F.col("id") % 3 == 0, F.lit(skew)).otherwise(family)
    return spark.range(n).select(F.concat(F.lit("r"), F.col("id")).alias("row_id"), family.alias("family"))


def sizes(dealt):
    return {r["client_id"]: r["count"] for r in dealt.groupBy("client_id").count().collect()}


def test_five_clients_with_exact_sizes_and_no_row_twice(spark):
    rows = pool(spark, 20000)
    dealt = partition.split_non_iid(rows, partition.make_specs(spark, 5, 42), 2000, seed=42).cache()
    assert sizes(dealt) == {i: 2000 for i in range(1, 6)}
    assert dealt.select("row_id").distinct().count() == 10000
    counts = {(r["client_id"], r["family"]): r["n"] for r in partition.family_counts(dealt).collect()}
    assert counts[(1, "normal")] == 1600 and counts[(2, "dos")] == 1500 and counts[(5, "r2l")] == 1200
    manifest = partition.split_manifest(dealt, partition.five_client_specs(spark), 2000, 42).orderBy("client_id").collect()
    assert [r["rows"] for r in manifest] == [2000] * 5
    assert manifest[0]["family_counts"]["normal"] == 1600 and manifest[0]["proportions"]["dos"] == 0.10


def test_thirty_clients(spark):
    dealt = partition.split_non_iid(pool(spark, 20000), partition.make_specs(spark, 30, 123), 100, seed=123)
    assert sizes(dealt) == {i: 100 for i in range(1, 31)}


def test_exhausted_pools_are_filled_without_overlap(spark):
    rows = pool(spark, 1001, skew="dos").where("family <> 'u2r'")
    total = rows.count()
    dealt = partition.split_non_iid(rows, partition.five_client_specs(spark), total // 5, seed=3)
    assert set(sizes(dealt).values()) == {total // 5}
    assert dealt.select("row_id").distinct().count() == 5 * (total // 5)


def test_default_size_and_more_asked_than_there_is(spark):
    rows = pool(spark, 103)
    dealt = partition.split_non_iid(rows, partition.five_client_specs(spark), seed=3)
    assert set(sizes(dealt).values()) == {20}
    greedy = partition.split_non_iid(rows, partition.five_client_specs(spark), 60, seed=3)
    assert sum(sizes(greedy).values()) == 103 and greedy.select("row_id").distinct().count() == 103


def test_layout_does_not_matter(spark):
    rows = pool(spark, 3000, skew="normal")
    split = lambda df: {
        (r["row_id"], r["client_id"])
        for r in partition.split_non_iid(df, partition.five_client_specs(spark), 400, seed=9).collect()
    }
    first = split(rows.repartition(1))
    assert first == split(rows.repartition(17))
    other = partition.split_non_iid(rows, partition.five_client_specs(spark), 400, seed=10)
    assert first != {(r["row_id"], r["client_id"]) for r in other.collect()}


def test_rounding_is_half_even_and_overshoot_is_removed(spark):
    specs = partition.specs_table(spark, [("half", {"normal": 0.045, "dos": 0.055}), ("over", {f: 0.2 for f in FAMILIES})])
    pools = spark.createDataFrame([(f, 1000) for f in FAMILIES], "family string, pool long")
    limits = partition.quota_limits(specs, pools, 100, seed=1).collect()
    half = {r["family"]: r["high"] - r["low"] for r in limits if r["client_id"] == 1}
    assert half == {"normal": 4, "dos": 6}
    for size in (13, 18):
        limits = partition.quota_limits(specs.where("client_id = 2"), pools, size, seed=1).collect()
        assert sum(r["high"] - r["low"] for r in limits) == size
        assert sum(r["top"] - r["low"] for r in limits) == {13: 15, 18: 20}[size]


def test_trimmed_rows_equal_the_picks_one_by_one(spark):
    """The closed form against evenly spaced picks from the client's start, for many sizes and clients."""
    specs = partition.specs_table(spark, [(f"c{i}", {f: 0.2 for f in FAMILIES}) for i in range(40)])
    pools = spark.createDataFrame([(f, 9) if f == "u2r" else (f, 1000) for f in FAMILIES], "family string, pool long")
    draws = {r[0]: r[1] for r in spark.range(1, 41).select("id", keyed_uniform(F.col("id").cast("int"), 5, "trim")).collect()}
    for size in (3, 13, 18):
        rows = partition.quota_limits(specs, pools, size, seed=5).collect()
        for client in range(1, 41):
            own = sorted((r for r in rows if r["client_id"] == client), key=lambda r: r["family"])
            n, over = sum(r["top"] - r["low"] for r in own), 0
            over = max(0, n - size)
            picks = [(int(draws[client] * n) + j * n // over) % n for j in range(over)]
            before = 0
            for r in own:
                hit = sum(before <= p < before + r["top"] - r["low"] for p in picks)
                assert r["top"] - r["high"] == hit
                before += r["top"] - r["low"]


def test_records_are_shuffled_once(spark):
    rows = pool(spark, 5000).withColumn("payload", F.repeat(F.col("row_id"), 20))
    dealt = partition.split_non_iid(rows, partition.five_client_specs(spark), 900, seed=2)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    keys = [re.sub(r"#\d+", "", keys).split(", ")[:-1] for keys in shuffles]
    assert plan.count("Window ") == 1 and keys.count(["_pool", "_bucket"]) == 1
    assert all(k in (["_pool", "_bucket"], ["_pool"]) for k in keys)  # the others are those of the few limits


def test_families_without_a_name_are_only_left_over(spark):
    rows = pool(spark, 1000).withColumn("family", F.when(F.col("family") != "u2r", F.col("family")))
    dealt = partition.split_non_iid(rows, partition.five_client_specs(spark), 200, seed=4)
    assert sizes(dealt) == {i: 200 for i in range(1, 6)} and dealt.select("row_id").distinct().count() == 1000


def test_preferred_families_are_used_up_first(spark):
    specs = partition.specs_table(spark, [("one", {"normal": 0.1})])
    dealt = partition.split_non_iid(pool(spark, 1000), specs, 300, seed=1, prefer=["u2r"])
    counts = {r["family"]: r["n"] for r in partition.family_counts(dealt).collect()}
    assert counts["u2r"] == 200 and sum(counts.values()) == 300


def test_generated_specs(spark):
    specs = partition.make_specs(spark, 12, 7).collect()
    totals = {}
    for r in specs:
        totals[r["client_id"]] = totals.get(r["client_id"], 0) + r["fraction"]
        assert 0 < r["fraction"] <= 0.95
    assert len(totals) == 12 and all(t <= 1 + 1e-9 for t in totals.values())
    main = {r["client_id"]: r["fraction"] for r in specs if r["family"] == "normal" and r["client_id"] in (1, 6, 11)}
    assert len(set(main.values())) == 3 and all(0.76 < v < 0.84 for v in main.values())
    with pytest.raises(ValueError):
        partition.make_specs(spark, 0, 7)


def test_bad_arguments(spark):
    with pytest.raises(ValueError, match="family"):
        partition.split_non_iid(spark.range(3), partition.five_client_specs(spark), 1)
    with pytest.raises(ValueError, match="client_size"):
        partition.split_non_iid(pool(spark, 3), partition.five_client_specs(spark), 0)


def test_label_flips(spark):
    rows = spark.range(20000).select(
        F.col("id").alias("row_id"), (F.col("id") % 4).alias("client_id"), (F.col("id") % 2).cast("int").alias("y")
    )
    flip = lambda rate, rnd=1, seed=1: noise.flip_labels(
        F.col("y"), F.col("client_id") == 2, rate, F.col("row_id"), F.col("client_id"), F.lit(rnd), seed
    )
    shares = rows.groupBy("client_id").agg(
        F.avg((flip(0.3) != F.col("y")).cast("int")).alias("some"),
        F.avg((flip(0.0) != F.col("y")).cast("int")).alias("none"),
        F.avg((flip(1.0) != F.col("y")).cast("int")).alias("all"),
        F.avg((flip(0.3) != flip(0.3, 2)).cast("int")).alias("redrawn"),
    )
    got = {r["client_id"]: r for r in shares.collect()}
    assert 0.27 < got[2]["some"] < 0.33 and got[2]["none"] == 0 and got[2]["all"] == 1 and got[2]["redrawn"] > 0.3
    assert all(got[c]["some"] == got[c]["all"] == 0 for c in (0, 1, 3))


def test_picked_clients(spark):
    clients = spark.range(1, 31).select(F.col("id").alias("client_id"))
    pick = lambda k, seed=1: sorted(r["client_id"] for r in noise.pick_clients(clients, k, seed).collect())
    assert len(pick(5)) == 5 and pick(5) == pick(5) and pick(5) != pick(5, 2)
    assert pick(0) == [] and pick(-1) == [] and pick(30) == pick(99) == list(range(1, 31))
