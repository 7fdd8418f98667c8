"""Labels and feature preparation on small hand-made tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from trustframe.functions import labels, scalars
from trustframe.operators import features


def test_labels(spark):
    df = spark.createDataFrame([(" normal..",), ("smurf.",), ("a.b. ",), (None,), ("guess_passwd",), ("perl",), ("nmap",)], "label string")
    rows = labels.with_family(df).select(
        labels.normalize_label(F.col("label")).alias("clean"), labels.binary_label(F.col("label")).alias("y"), "family"
    ).collect()
    assert [r["clean"] for r in rows] == ["normal", "smurf", "a.b", "nan", "guess_passwd", "perl", "nmap"]
    assert [r["y"] for r in rows] == [0, 1, 1, 1, 1, 1, 1]
    assert [r["family"] for r in rows] == ["normal", "dos", "unknown", "unknown", "r2l", "u2r", "probe"]
    with pytest.raises(ValueError):
        labels.with_family(df.withColumnRenamed("label", "other"))
    assert {f: len(m) for f, m in labels.FAMILY_MEMBERS.items()} == {"normal": 1, "dos": 10, "probe": 6, "r2l": 15, "u2r": 8}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.sigmoid(F.lit(0.0)).alias("s"),
        scalars.predict_at_half(F.lit(0.0)).alias("p"),
        scalars.logit_loss(F.lit(-800.0), F.lit(1.0)).alias("big"),
        scalars.round_half_even(F.lit(4.5)).alias("even"),
        scalars.parse_int_list(F.lit(" 1, 2,,5 ,")).alias("ids"),
        scalars.parse_int_list(F.lit("")).alias("none"),
        scalars.format_int_list(F.array(F.lit(3), F.lit(1))).alias("text"),
        scalars.ratio_or_zero(F.lit(1), F.lit(0)).alias("zero"),
        scalars.iso_utc(F.lit("2024-01-02T03:04:05.5+01:00").cast("timestamp")).alias("iso"),
    ).first()
    assert row["s"] == 0.5 and row["p"] == 1 and row["big"] == 800.0 and row["even"] == 4.0
    assert row["ids"] == [1, 2, 5] and row["none"] == [] and row["text"] == "3,1" and row["zero"] == 0.0
    assert row["iso"] == "2024-01-02T02:04:05.500000+00:00"


@pytest.fixture(scope="module")
def train(spark):
    rows = [("b", 1.0, 5.0, "normal"), ("a", 2.0, 5.0, "smurf"), ("b", None, 5.0, "normal."), ("a", 3.0, 5.0, "x"), (None, 4.0, 5.0, "x")]
    return spark.createDataFrame(rows, "kind string, size double, fixed double, label string")


@pytest.mark.parametrize("direct_rows", [1_000_000, 1])
def test_fit(train, direct_rows):
    fitted = features.fit_features(train, ["kind", "absent"], ["size", "fixed"], direct_rows=direct_rows)
    assert fitted.categorical == {"kind": ("a", ["a", "b"])}
    median, mean, std = fitted.numeric["size"]
    filled = [1.0, 2.0, 2.5, 3.0, 4.0]
    assert median == 2.5 and mean == pytest.approx(2.5)
    assert std == pytest.approx(math.sqrt(sum((v - 2.5) ** 2 for v in filled) / 5))
    assert fitted.numeric["fixed"] == (5.0, 5.0, 0.0)
    assert fitted.names == ["kind_a", "kind_b", "size", "fixed"]


def test_transform_of_another_split(spark, train):
    fitted = features.fit_features(train, ["kind"], ["size", "fixed"])
    other = spark.createDataFrame([("new", 2.5, 6.0, "normal"), (None, None, None, "x")], train.schema)
    rows = fitted.transform(other, ["label"]).collect()
    assert rows[0].asDict() == {"label": "normal", "kind_a": 0.0, "kind_b": 0.0, "size": 0.0, "fixed": 1.0}
    assert rows[1].asDict() == {"label": "x", "kind_a": 1.0, "kind_b": 0.0, "size": 0.0, "fixed": 0.0}
    assert fitted.transform(train).columns == fitted.transform(other).columns == fitted.names
    again = features.FittedFeatures.from_table(fitted.to_table(spark))
    assert again == fitted


def test_transform_is_a_projection(train):
    plan = features.fit_features(train, ["kind"], ["size"]).transform(train)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_prepare(train):
    out = features.prepare(train, ["kind"], ["size"])
    assert out.columns == ["kind_a", "kind_b", "size", "label"]
    assert [r["label"] for r in out.collect()] == [0, 1, 0, 1, 1]
    with pytest.raises(ValueError):
        features.prepare(train.drop("label"), ["kind"], ["size"])


def test_sparse_encoding_equals_wide(spark, train):
    long = features.one_hot_long(train.withColumn("id", F.monotonically_increasing_id()), ["id"], ["kind"], features.level_counts(train, ["kind"]))
    assert sorted((r["col"], r["level"]) for r in long.collect()) == [("kind", "a")] * 3 + [("kind", "b")] * 2


@pytest.mark.parametrize("levels", [features.MAX_LEVELS, features.MAX_LEVELS + 1])
def test_many_levels_fit_on_both_sides_of_the_limit(spark, levels):
    """Vectors hold the cells that columns would: place of the level in sorted order, zeros for an unseen one."""
    kind = F.concat(F.lit("k"), F.col("id"))
    train = spark.range(levels).select(kind.alias("kind"), F.col("id").cast("double").alias("x")).repartition(3)
    fitted = features.fit_features(train.unionAll(train.where("kind = 'k7'")), ["kind"], ["x"])
    ordered = sorted(f"k{i}" for i in range(levels))
    other = spark.createDataFrame([("k3", 1.0), ("k1999", 2.0), (None, 3.0), ("new", 4.0)], "kind string, x double")
    rows = sorted(fitted.transform(other, [F.col("x").alias("key")]).collect(), key=lambda r: r["key"])
    if levels <= features.MAX_LEVELS:
        cells = [[r[f"kind_{level}"] for level in ordered] for r in rows]
    else:
        assert fitted.names == ["x"] and fitted.vector_names == ["kind_levels"]
        cells = [r["kind_levels"].toArray().tolist() for r in rows]
    at = [ordered.index("k3"), ordered.index("k1999"), ordered.index("k7"), None]  # a null reads as the most frequent
    assert cells == [[float(i == place) for i in range(levels)] for place in at]


def test_two_wide_columns_beside_a_narrow_one(spark):
    rows = [(f"a{i % 5}", f"b{i % 4}", f"c{i % 2}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "a string, b string, c string, x double")
    wide = features.fit_features(df, ["a", "b", "c"], ["x"], max_levels=3)
    dense = features.fit_features(df, ["a", "b", "c"], ["x"])
    assert set(wide.wide) == {"a", "b"} and set(wide.categorical) == {"c"}
    again = features.FittedFeatures.from_table(wide.to_table(spark), wide.levels.df)
    for fitted in (wide, again):
        got = {r["key"]: [*r["a_levels"].toArray(), *r["b_levels"].toArray(), r["c_c0"], r["c_c1"], r["x"]] for r in fitted.transform(df, [F.col("x").alias("key")]).collect()}
        want = {r["key"]: [r[n] for n in [*(f"a_a{i}" for i in range(5)), *(f"b_b{i}" for i in range(4)), "c_c0", "c_c1", "x"]] for r in dense.transform(df, [F.col("x").alias("key")]).collect()}
        assert got == want


def test_column_without_values_is_left_out(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "empty double, x double")
    fitted = features.fit_features(df, [], ["empty", "x"])
    assert list(fitted.numeric) == ["x"] and fitted.numeric["x"] == (1.0, 1.0, 0.0)
