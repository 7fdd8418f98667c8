"""Update algebra, reducers and trust on small hand-made tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from trustframe.functions import arrays
from trustframe.operators import metrics, trust, updates

SCHEMA = "scenario_id int, round int, client_id long, weight double, values array<double>"


def table(spark, vectors, weights=None):
    weights = weights or [1.0] * len(vectors)
    rows = [(0, 1, i, float(w), [float(x) for x in v]) for i, (v, w) in enumerate(zip(vectors, weights), start=1)]
    return spark.createDataFrame(rows, SCHEMA)


def vector(df):
    return [r["value"] for r in sorted(df.collect(), key=lambda r: r["pos"])]


def test_even_count_takes_the_lower_median(spark):
    assert vector(updates.coordinate_median(table(spark, [[1], [2], [3], [4]]))) == [2.0]


@pytest.mark.parametrize("direct_rows", [1_000_000, 2])
def test_trimmed_mean(spark, direct_rows):
    data = table(spark, [[1, 5], [2, 5], [3, 5], [4, 5], [100, 5]])
    assert vector(updates.trimmed_mean(data, 0.2, direct_rows=direct_rows)) == [3.0, 5.0]
    ties = table(spark, [[1], [1], [1], [2], [3], [3], [3], [9]])
    assert vector(updates.trimmed_mean(ties, 0.25, direct_rows=direct_rows)) == [pytest.approx(9 / 4)]
    diverged = table(spark, [[1.0], [2.0], [3.0], [4.0], [float("nan")]])
    assert vector(updates.trimmed_mean(diverged, 0.25, direct_rows=direct_rows)) == [2.5]
    assert vector(updates.trimmed_mean(table(spark, [[1], [4]]), 0.49, direct_rows=direct_rows)) == [2.5]
    with pytest.raises(ValueError):
        updates.trimmed_mean(data, 0.5)


def test_trimmed_mean_without_trimming_and_equal_weights_are_the_mean(spark):
    data = table(spark, [[1, -4], [2, 6], [6, 1]])
    assert vector(updates.trimmed_mean(data, 0.0)) == pytest.approx(vector(updates.plain_mean(data)))
    assert vector(updates.weighted_mean(data)) == pytest.approx(vector(updates.plain_mean(data)))
    assert vector(updates.weighted_mean(table(spark, [[1], [4]], [3, 1]))) == [1.75]


def test_invalid_updates(spark):
    with pytest.raises(ValueError, match="no client"):
        updates.validate_updates(table(spark, [[1]]).limit(0))
    with pytest.raises(ValueError, match="same length"):
        updates.validate_updates(table(spark, [[1], [1, 2]]))
    with pytest.raises(ValueError, match="greater than 0"):
        updates.validate_updates(table(spark, [[1]], [0]))
    with pytest.raises(Exception, match="greater than 0"):
        updates.weighted_mean(table(spark, [[1]], [0])).collect()


def test_clipping(spark):
    data = updates.clip_updates(table(spark, [[3, 4], [0, 0], [0.3, 0.4]]), 1.0)
    got = [r["values"] for r in data.orderBy("client_id").collect()]
    assert got[0] == pytest.approx([0.6, 0.8])
    assert got[1] == [0.0, 0.0] and got[2] == [0.3, 0.4]
    assert updates.clip_updates(data, None) is data


def test_state_algebra(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "a array<double>, b array<double>").select(
        arrays.add(F.col("a"), F.col("b")).alias("add"),
        arrays.subtract(F.col("a"), F.col("b")).alias("sub"),
        arrays.scale(F.col("a"), F.lit(2.0)).alias("scaled"),
        arrays.cosine(F.col("a"), F.array(F.lit(0.0), F.lit(0.0))).alias("none"),
        arrays.cosine(F.col("a"), F.col("a")).alias("same"),
    ).first()
    assert row["add"] == [4.0, 7.0] and row["sub"] == [-2.0, -3.0] and row["scaled"] == [2.0, 4.0]
    assert row["none"] == 0.0 and row["same"] == pytest.approx(1.0)
    packed = updates.assemble(updates.flatten(table(spark, [[9, 8, 7]]), ["scenario_id", "round"]))
    assert packed.first()["values"] == [9.0, 8.0, 7.0]


def scored(spark, vectors, config, weights=None):
    return trust.score_updates(table(spark, vectors, weights), config)


def test_lowest_similarity_is_dropped_and_ties_go_to_the_lower_id(spark):
    config = trust.MergeConfig("cosine", drop_k=1)
    rows = scored(spark, [[1, 0], [1, 0.1], [-1, 0]], config).orderBy("client_id").collect()
    assert [r["used"] for r in rows] == [True, True, False]
    tied = scored(spark, [[1, 1], [1, 1], [1, 1]], config).orderBy("client_id").collect()
    assert [r["used"] for r in tied] == [False, True, True]
    for drop_k in (0, 3, 9):
        kept = scored(spark, [[1, 0], [0, 1], [-1, 0]], trust.MergeConfig("cosine", drop_k=drop_k))
        assert kept.where("used").count() == 3


def test_trust_weights_and_their_fallback(spark):
    data = table(spark, [[2.0], [6.0]], [1, 3]).withColumn("used", F.lit(True))
    trusted = data.withColumn("trust", F.when(F.col("client_id") == 1, 0.9).otherwise(0.1))
    assert vector(trust.trust_weighted_mean(trusted)) == pytest.approx([(2 * 0.9 + 6 * 0.3) / 1.2])
    assert vector(trust.trust_weighted_mean(data.withColumn("trust", F.lit(0.0)))) == [5.0]


def test_trust_score_limits(spark):
    config = trust.MergeConfig("cosine", alpha=0.0, beta=0.0, gamma=0.0)
    one = spark.range(1).select(
        trust.trust_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), config).alias("none"),
        trust.trust_score(F.lit(1.0), F.lit(0.5), F.lit(0.0), trust.MergeConfig("cosine", alpha=1, beta=1, gamma=0)).alias("half"),
        trust.loss_stability(F.lit(1.0), F.lit(0.5)).alias("better"),
        trust.loss_stability(F.lit(0.5), F.lit(1.5)).alias("worse"),
    ).first()
    assert one["none"] == 0.0 and one["half"] == 0.75 and one["better"] == 1.0 and one["worse"] == 0.5


def test_one_huge_update_moves_the_mean_only(spark):
    honest = [[1.0 + i / 10, -1.0 - i / 10] for i in range(6)]
    attacked = honest + [[1000.0, 1000.0]]
    shift = lambda strategy: abs(vector(trust.merge_updates(table(spark, attacked), trust.MergeConfig(strategy)))[1] + 1.25)
    assert shift("fedavg") > 100
    assert shift("median") < 0.2 and shift("trimmed_mean") < 0.2
    clipped = trust.merge_updates(table(spark, attacked), trust.MergeConfig("fedavg", clip_norm=1.0))
    assert abs(vector(clipped)[1]) < 1


def test_unknown_strategy():
    with pytest.raises(ValueError, match="unknown merge strategy"):
        trust.MergeConfig("best")


def test_feedback_depends_on_the_strategy(spark):
    dropped = trust.client_feedback(scored(spark, [[1, 0], [1, 0.1], [-1, 0]], trust.MergeConfig("cosine", drop_k=1)))
    rows = dropped.orderBy("client_id").collect()
    assert [r["notes"] for r in rows] == [None, None, "dropped_by_server"]
    assert all(r["trust"] is not None for r in rows)
    plain = trust.client_feedback(scored(spark, [[1, 0], [-1, 0]], trust.MergeConfig("fedavg")))
    assert all(r["used"] and r["trust"] is None and r["cosine_similarity"] is None for r in plain.collect())
    assert metrics.round_diagnostics(plain).first()["dropped_clients"] is None
    assert metrics.round_diagnostics(dropped).first()["dropped_clients"] == 1.0


LAYERS = {"a": ["x"], "b": ["z", "name"], "c": ["missing"]}


@pytest.mark.parametrize("direct_rows", [1_000_000, 2])
def test_cross_layer(spark, direct_rows):
    # Layer a is dense (intensity 1); layer b is a sparse counter without spread (intensity 0).
    rows = [(1, float(i), 0.0 if i else 9.0, "n") for i in range(7)] + [(2, 5.0, 5.0, "n")]
    df = spark.createDataFrame(rows, "client_id int, x double, z double, name string")
    got = {r["client_id"]: r["score"] for r in trust.cross_layer_score(df, groups=LAYERS, direct_rows=direct_rows).collect()}
    assert got[1] == pytest.approx(1 / 1.5)
    assert got[2] == pytest.approx(1.0)
    single = trust.cross_layer_score(df, groups={"a": ["x"], "b": ["name"]})
    assert {r["score"] for r in single.collect()} == {0.0}


def test_metrics_without_positives_or_negatives(spark):
    df = spark.createDataFrame([("neg", 0, 0), ("pos", 1, 0), ("pos", 1, 1), ("mix", 1, 1), ("mix", 0, 1)], "g string, y int, p int")
    got = {r["g"]: r for r in metrics.binary_metrics(df, F.col("y"), F.col("p"), ["g"]).collect()}
    assert got["neg"]["recall"] == got["neg"]["precision"] == got["neg"]["f1"] == got["neg"]["false_negative_rate"] == 0
    assert got["neg"]["accuracy"] == 1
    assert got["pos"]["false_positive_rate"] == 0 and got["pos"]["recall"] == 0.5
    assert got["mix"]["false_positive_rate"] == 1 and math.isclose(got["mix"]["f1"], 2 / 3)
