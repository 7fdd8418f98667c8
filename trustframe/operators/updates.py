"""Client model updates: conversion, clipping and robust reducers.

An update table has one row per client and group: the group keys (by default ``scenario_id, round``), ``client_id``,
``weight`` (rows the client trained on) and ``values array<double>`` in a fixed coordinate order. Reducers explode
the arrays inside the scan stage and aggregate by coordinate, so what is shuffled is one partial sum per coordinate
and task, never the vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trustframe.functions import arrays
from trustframe.operators.materialize import cut_lineage, join_checked, settle
from trustframe.operators.order_stats import DIRECT_ROWS, largest_group, lower_median, select_ranks

KEYS = ("scenario_id", "round")


def validate_updates(updates: DataFrame, keys: Sequence[str] = KEYS) -> None:
    """Raise when there is no update, when vector lengths differ in a group, or when weights sum to nothing."""
    groups = updates.groupBy(*keys).agg(
        F.min(F.size("values")).alias("shortest"),
        F.max(F.size("values")).alias("longest"),
        F.sum("weight").alias("total"),
    )
    checks = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("shortest") != F.col("longest")).alias("ragged"),
        F.count_if(~(F.col("total") > 0)).alias("weightless"),
    ).first()
    if not checks["groups"]:
        raise ValueError("no client updates to merge")
    if checks["ragged"]:
        raise ValueError("client updates of one group must have the same length")
    if checks["weightless"]:
        raise ValueError("sum of client weights must be greater than 0")


def checked_updates(updates: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Write updates to the checkpoint folder and go on from there; raise when they cannot be merged.

    One aggregate without a shuffle reads the written copy: some rows, one length and weights above 0 are sound. Only
    where lengths differ or a weight is not above 0 are the groups looked at one by one. (Metrics observed during the
    write would save that read, but a session that has observed any can no longer serialise models of ``pyspark.ml``.)
    """
    kept = cut_lineage(updates)
    width, weight = F.size("values"), F.col("weight").cast("double")
    found = kept.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(width).alias("shortest"),
        F.max(width).alias("longest"),
        F.count_if(F.coalesce(weight > 0, F.lit(False))).alias("weighted"),
    ).first()
    if not found["rows"] or found["shortest"] != found["longest"] or found["weighted"] != found["rows"]:
        validate_updates(kept, keys)
    return kept


def flatten(updates: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per coordinate: the kept columns, ``pos`` and ``value``."""
    return updates.select(*keep, F.posexplode("values").alias("pos", "value"))


def assemble(coordinates: DataFrame, keys: Sequence[str] = KEYS, out: str = "values") -> DataFrame:
    """Coordinates back to one array per group; a group has as many rows as the model has coordinates."""
    packed = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return coordinates.groupBy(*keys).agg(F.transform(packed, lambda item: item["value"]).alias(out))


def state_delta(states: DataFrame, base: DataFrame, on: Sequence[str]) -> DataFrame:
    """Update of each state relative to the base state of its group (column ``base``)."""
    joined = join_checked(states, settle(base), list(on))
    return joined.withColumn("values", arrays.subtract(F.col("values"), F.col("base"))).drop("base")


def clip_updates(updates: DataFrame, max_norm: float | None) -> DataFrame:
    if max_norm is None:
        return updates
    return updates.withColumn("values", arrays.clip_to_norm(F.col("values"), max_norm))


def positive_total(total: Column) -> Column:
    return F.when(total > 0, total).otherwise(
        F.raise_error(F.lit("sum of client weights must be greater than 0")).cast("double")
    )


def weighted_mean(updates: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean by coordinate, weighted by client rows: ``(keys..., pos, value)``."""
    coordinates = flatten(updates, [*keys, "weight"])
    return coordinates.groupBy(*keys, "pos").agg(
        (F.sum(F.col("value") * F.col("weight")) / positive_total(F.sum("weight").cast("double"))).alias("value")
    )


def plain_mean(updates: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return flatten(updates, keys).groupBy(*keys, "pos").agg(F.avg("value").alias("value"))


def coordinate_median(
    updates: DataFrame, keys: Sequence[str] = KEYS, direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """Lower median by coordinate. Group sizes are counted on the clients, before the vectors are exploded."""
    return lower_median(
        flatten(updates, keys),
        [*keys, "pos"],
        "value",
        out="value",
        group_rows=largest_group(updates, list(keys)),
        direct_rows=direct_rows,
    ).drop("n")


def trim_count(n: Column, ratio: float) -> Column:
    """Values cut at each end; nothing is cut when that would leave none."""
    cut = F.floor(F.lit(float(ratio)) * n).cast("long")
    return F.when(2 * cut < n, cut).otherwise(F.lit(0).cast("long"))


def trimmed_mean(
    updates: DataFrame, ratio: float, keys: Sequence[str] = KEYS, direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """Mean by coordinate without the lowest and highest ``floor(ratio * n)`` of the values that are numbers."""
    if not 0.0 <= ratio < 0.5:
        raise ValueError("trim ratio must be in [0, 0.5)")
    by = [*keys, "pos"]
    coordinates = flatten(updates, keys).where(~F.isnan("value"))
    group_rows = largest_group(updates, list(keys))
    if group_rows <= direct_rows:
        gathered = coordinates.groupBy(*by).agg(F.sort_array(F.collect_list("value")).alias("_sorted"))
        n = F.size("_sorted")
        cut = trim_count(n, ratio).cast("int")
        kept = F.slice("_sorted", cut + 1, n - 2 * cut)
        total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
        return gathered.select(*by, (total / (n - 2 * cut)).alias("value"))

    # Positions of the first and last kept value, then one summing pass; ties at both ends are counted, not guessed.
    limits = settle(
        select_ranks(
            coordinates,
            by,
            "value",
            lambda n: {"low": trim_count(n, ratio) + 1, "high": n - trim_count(n, ratio)},
            group_rows=group_rows,
            direct_rows=direct_rows,
        )
    )
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    sums = (
        join_checked(coordinates, limits, by)
        .groupBy(*by, "n", "low", "high")
        .agg(
            F.coalesce(F.sum(F.when((value > low) & (value < high), value)), F.lit(0.0)).alias("inner"),
            F.count_if(value <= low).alias("upto_low"),
            F.count_if(value < high).alias("below_high"),
        )
    )
    cut = trim_count(F.col("n"), ratio)
    total = (
        F.col("inner")
        + low * (F.col("upto_low") - cut)
        + high * (F.col("n") - cut - F.col("below_high"))
    )
    mean = F.when(low == high, low).otherwise(total / (F.col("n") - 2 * cut))
    return sums.select(*by, mean.alias("value"))
