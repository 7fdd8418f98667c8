"""Trust of client updates, outlier removal and the choice of merge strategy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trustframe.functions import arrays
from trustframe.functions.scalars import clip
from trustframe.operators.features import numeric_columns
from trustframe.operators.materialize import cut_lineage, join_checked, settle
from trustframe.operators.order_stats import DIRECT_ROWS, exact_median, largest_group, with_counted_median
from trustframe.operators.rank import smallest_limit
from trustframe.operators.updates import (
    KEYS,
    assemble,
    checked_updates,
    clip_updates,
    coordinate_median,
    flatten,
    plain_mean,
    positive_total,
    trimmed_mean,
    weighted_mean,
)

STRATEGIES = ("fedavg", "cosine", "trimmed_mean", "median")

# Raw columns of each protocol layer.
LAYER_GROUPS: dict[str, list[str]] = {
    "network": ["duration", "src_bytes", "dst_bytes", "count", "srv_count"],
    "transport": ["protocol_type", "flag", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate"],
    "application": ["service", "logged_in", "num_failed_logins", "hot", "num_compromised"],
}


@dataclass(frozen=True)
class MergeConfig:
    """How client updates become one update."""

    strategy: str = "fedavg"
    drop_k: int = 0
    clip_norm: float | None = None
    trim_ratio: float = 0.2
    alpha: float = 1.0
    beta: float = 0.0
    gamma: float = 0.5

    def __post_init__(self) -> None:
        if self.strategy.lower() not in STRATEGIES:
            raise ValueError(f"unknown merge strategy: {self.strategy}")


def loss_stability(before: Column, after: Column) -> Column:
    """1 when local training did not raise the client's own loss, falling towards 0 as it rises."""
    return clip(F.lit(1.0) / (F.lit(1.0) + F.greatest(F.lit(0.0), after - before)), 0.0, 1.0)


def with_similarity(updates: DataFrame, keys: Sequence[str] = KEYS, out: str = "cosine_similarity") -> DataFrame:
    """Cosine of each update to the unweighted mean update of its group.

    The means are one short row per group. They are computed once and broadcast when small enough, so the
    vectors are not shuffled.
    """
    keys = list(keys)
    means = settle(assemble(plain_mean(updates, keys), keys, out="_mean"))
    return join_checked(updates, means, keys).withColumn(
        out, arrays.cosine(F.col("values"), F.col("_mean"))
    ).drop("_mean")


def trust_score(similarity: Column, stability: Column, layers: Column, config: MergeConfig) -> Column:
    a, b, c = float(config.alpha), float(config.beta), float(config.gamma)
    cosine_part = F.greatest(F.lit(0.0), (similarity + 1.0) / 2.0)
    mixed = F.lit(a) * cosine_part + F.lit(b) * stability + F.lit(c) * layers
    return clip(mixed / F.lit(max(1e-12, a + b + c)), 0.0, 1.0)


def with_used_flag(scored: DataFrame, drop_k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Flag the clients that stay after removing the ``drop_k`` of lowest similarity in each group.

    Nothing is removed when ``drop_k`` is not below the group size. Equal similarities fall to the lower client
    id. Only the upper limit of the k lowest is joined back.
    """
    if drop_k <= 0:
        return scored.withColumn("used", F.lit(True))
    keys = list(keys)
    limits = smallest_limit(scored, keys, "cosine_similarity", "client_id", drop_k)
    sizes = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_clients"))
    limits = limits.join(sizes, keys) if keys else limits.crossJoin(sizes)
    limits = settle(limits.withColumn("_drops", F.col("_clients") > drop_k).drop("_clients"))
    position = F.struct("cosine_similarity", "client_id")
    return (
        join_checked(scored, limits, keys)
        .withColumn("used", ~F.col("_drops") | (position > F.col("_limit")))
        .drop("_drops", "_limit")
    )


def trust_weighted_mean(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the used updates weighted by rows times trust; by rows alone when the trust sums to nothing.

    The normaliser of the trust cancels out of the mean, so both candidate means come from one aggregate.
    """
    used = scored.where("used")
    coordinates = flatten(used, [*keys, "weight", "trust"])
    value, weight, trust = F.col("value"), F.col("weight"), F.col("trust")
    sums = coordinates.groupBy(*keys, "pos").agg(
        F.sum(trust).alias("trust"),
        F.sum(weight * trust * value).alias("trusted"),
        F.sum(weight * trust).alias("trusted_weight"),
        F.sum(weight * value).alias("plain"),
        F.sum(weight.cast("double")).alias("plain_weight"),
    )
    merged = F.when(
        F.col("trust") <= 1e-12, F.col("plain") / positive_total(F.col("plain_weight"))
    ).otherwise(F.col("trusted") / positive_total(F.col("trusted_weight")))
    return sums.select(*keys, "pos", merged.alias("value"))


def score_updates(updates: DataFrame, config: MergeConfig, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``cosine_similarity``, ``trust`` and ``used``; the first two stay null unless the strategy uses them.

    ``loss_stability`` and ``cross_layer`` columns are read when present and count as 0 otherwise.
    """
    if config.strategy.lower() != "cosine":
        return (
            updates.withColumn("cosine_similarity", F.lit(None).cast("double"))
            .withColumn("trust", F.lit(None).cast("double"))
            .withColumn("used", F.lit(True))
        )
    present = lambda name: F.col(name) if name in updates.columns else F.lit(0.0)
    similar = with_similarity(updates, keys)
    scored = similar.withColumn(
        "trust",
        trust_score(F.col("cosine_similarity"), present("loss_stability"), present("cross_layer"), config),
    )
    return with_used_flag(scored, config.drop_k, keys)


def merge_scored(scored: DataFrame, config: MergeConfig, keys: Sequence[str] = KEYS) -> DataFrame:
    strategy = config.strategy.lower()
    if strategy == "fedavg":
        return weighted_mean(scored, keys)
    if strategy == "cosine":
        return trust_weighted_mean(scored, keys)
    if strategy == "trimmed_mean":
        return trimmed_mean(scored, config.trim_ratio, keys)
    return coordinate_median(scored, keys)


def merge_updates(updates: DataFrame, config: MergeConfig, keys: Sequence[str] = KEYS) -> DataFrame:
    """Merged update of each group as ``(keys..., pos, value)``; clipping applies to every strategy.

    The clipped updates are written once and checked on the way: none at all, different lengths in a group and
    weights that sum to nothing raise.
    """
    checked = checked_updates(clip_updates(updates, config.clip_norm), keys)
    return merge_scored(score_updates(checked, config, keys), config, keys)


def client_feedback(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per client and round to send back: was the update used, and why."""
    present = lambda name: F.col(name) if name in scored.columns else F.lit(None).cast("double").alias(name)
    return scored.select(
        *keys,
        "client_id",
        "used",
        "trust",
        "cosine_similarity",
        present("loss_stability"),
        present("cross_layer"),
        F.when(~F.col("used"), F.lit("dropped_by_server")).alias("notes"),
    )


def cross_layer_score(
    records: DataFrame,
    client: str = "client_id",
    groups: dict[str, list[str]] | None = None,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Agreement between the anomaly intensity of the feature layers of each client: ``(client, score)``.

    Intensity of a layer is the median over all its cells of ``|x - median| / MAD`` with MAD 0 counted as 0; the
    score is ``1 / (1 + population std of the intensities)``, and 0 with fewer than two layers.
    """
    groups = LAYER_GROUPS if groups is None else groups
    numeric = set(numeric_columns(records))
    layers = {layer: [c for c in columns if c in numeric] for layer, columns in groups.items()}
    layers = {layer: columns for layer, columns in layers.items() if columns}
    if len(layers) < 2:
        return records.select(client).distinct().select(client, F.lit(0.0).alias("score"))

    cells = [
        F.struct(F.lit(layer).alias("layer"), F.lit(column).alias("feature"), F.col(column).cast("double").alias("x"))
        for layer, columns in layers.items()
        for column in columns
    ]
    # The records are exploded once. What follows works on the different values of each feature with their counts, so
    # equal cells of a hot client are summed up before the shuffle and its other cells are spread by value.
    long = records.select(client, F.inline(F.array(*cells))).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    values = cut_lineage(long.groupBy(client, "layer", "feature", "x").agg(F.count(F.lit(1)).alias("times")))
    of_feature, of_layer = [client, "layer", "feature"], [client, "layer"]
    rows = largest_group(values, of_layer)
    if rows <= direct_rows:
        centered = with_counted_median(values, of_feature, "x", "times", "center")
        centered = centered.withColumn("distance", F.abs(F.col("x") - F.col("center")))
        spread = with_counted_median(centered, of_feature, "distance", "times", "mad")
    else:
        limits = {"group_rows": rows, "direct_rows": direct_rows, "weight": "times"}
        medians = settle(exact_median(values, of_feature, "x", out="center", **limits).drop("n"))
        centered = join_checked(values, medians, of_feature, "left")
        centered = centered.withColumn("distance", F.abs(F.col("x") - F.col("center")))
        spreads = settle(exact_median(centered, of_feature, "distance", out="mad", **limits).drop("n"))
        spread = join_checked(centered, spreads, of_feature, "left")
    z = F.col("distance") / F.nullif("mad", F.lit(0.0))
    finite = F.coalesce(F.when(F.isnan(z) | (F.abs(z) == float("inf")), F.lit(0.0)).otherwise(z), F.lit(0.0))
    counted = spread.groupBy(*of_layer, finite.alias("z")).agg(F.sum("times").alias("times"))
    intensities = exact_median(
        counted, of_layer, "z", out="intensity", group_rows=rows, direct_rows=direct_rows, weight="times"
    )
    return intensities.groupBy(client).agg(
        clip(F.lit(1.0) / (F.lit(1.0) + F.stddev_pop("intensity")), 0.0, 1.0).alias("score")
    )
