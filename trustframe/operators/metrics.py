"""Confusion counts, binary metrics and round diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trustframe.functions.scalars import ratio_or_zero
from trustframe.operators.updates import KEYS


def binary_metrics(
    df: DataFrame, truth: Column, predicted: Column, keys: Sequence[str] = (), count: Column | None = None
) -> DataFrame:
    """Confusion counts and ratios per group in one pass; a ratio with nothing to divide by is 0."""
    once = F.lit(1).cast("long") if count is None else count
    tally = lambda hit: F.coalesce(F.sum(F.when(hit, once)), F.lit(0)).cast("long")
    counts = df.groupBy(*keys).agg(
        tally((truth == 1) & (predicted == 1)).alias("tp"),
        tally((truth == 0) & (predicted == 1)).alias("fp"),
        tally((truth == 0) & (predicted == 0)).alias("tn"),
        tally((truth == 1) & (predicted == 0)).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(name) for name in ("tp", "fp", "tn", "fn"))
    return counts.select(
        *keys,
        "tp",
        "fp",
        "tn",
        "fn",
        ratio_or_zero(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio_or_zero(fp, fp + tn).alias("false_positive_rate"),
        ratio_or_zero(fn, fn + tp).alias("false_negative_rate"),
    )


def round_diagnostics(feedback: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Summary of the client feedback of each round; what was not logged stays null."""
    dropped = F.count_if(~F.col("used"))
    return feedback.groupBy(*keys).agg(
        F.min("cosine_similarity").alias("cosine_sim_min"),
        F.avg("cosine_similarity").alias("cosine_sim_mean"),
        F.min("trust").alias("trust_min"),
        F.avg("trust").alias("trust_mean"),
        F.avg("loss_stability").alias("loss_stability_mean"),
        F.avg("cross_layer").alias("cross_layer_mean"),
        F.when(dropped > 0, dropped.cast("double")).alias("dropped_clients"),
    )
