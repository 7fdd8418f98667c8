"""Comparing runs: merging logs, final rounds, metric series, defence signals and client feedback."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from trustframe.operators.materialize import Settled, join_checked, literal_table, settle
from trustframe.operators.rank import smallest_limit
from trustframe.sources.runs import METRICS, latest_rounds

# Run names of the standard comparison, and defence signals from most to least telling.
STANDARD_RUNS = [
    "Centralized_baseline",
    "baseline_FedAvg",
    "Poisoning_attack(label_flipping)",
    "Cross-layer_trust_weighting(cosine)+outlier_drop",
    "trimmed_mean(clipping+robust aggregation)",
    "coordinate_median(trimming+robust aggregation)",
]
DEFENSE_SIGNALS = ["trust_mean", "cosine_sim_mean", "dropped_clients", "loss_stability_mean", "cross_layer_mean"]
NO_SIGNAL = "accuracy"


def merge_runs(runs: Mapping[str, DataFrame]) -> DataFrame:
    """Logs of several runs under each other, latest row per round; columns a run lacks are null.

    The logs become one table first, so any number of runs is reduced by one aggregate with the run as a key. A log
    without ``round`` is a single point, round 1.
    """
    frames = [
        frame.withColumns({"run_name": F.lit(name), "round": (F.col("round") if "round" in frame.columns else F.lit(1)).cast("int")})
        for name, frame in runs.items()
    ]
    if not frames:
        raise ValueError("no runs to merge")
    merged = latest_rounds(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))
    return merged.select("run_name", *[name for name in merged.columns if name != "run_name"])


def select_runs(
    rounds: DataFrame,
    wanted: Sequence[str] | None = None,
    standard: Sequence[str] = tuple(STANDARD_RUNS),
    skip_prefix: str | None = None,
) -> DataFrame:
    """Rounds of the wanted runs; without a wish, the standard runs when all of them exist, else every run.

    ``skip_prefix`` leaves out runs by the start of their name, such as the year of runs named by time.
    """
    spark = rounds.sparkSession
    if skip_prefix:
        rounds = rounds.where(~F.col("run_name").startswith(skip_prefix))
    names = list(standard) if wanted is None else [name.strip() for name in wanted if name.strip()]
    if not names:
        return rounds if wanted is None else rounds.limit(0)
    listed = Settled(literal_table(spark, [(name,) for name in dict.fromkeys(names)], "run_name string"), len(names) < 100_000)
    if wanted is None:
        present = rounds.where(F.col("run_name").isin(*names)).select("run_name").distinct().count()
        if present < len(names):
            return rounds
    return join_checked(rounds, listed, ["run_name"], "left_semi")


def final_rounds(rounds: DataFrame, run: str = "run_name", tie: Sequence[str] = ()) -> DataFrame:
    """Row of the last round of each run, the best known metrics first."""
    rest = [name for name in rounds.columns if name != run]
    last = rounds.groupBy(run).agg(F.max_by(F.struct(*rest), F.struct("round", *tie)).alias("_last"))
    first = [name for name in ["round", *METRICS] if name in rest]
    return last.select(run, "_last.*").select(run, *first, *[name for name in rest if name not in first])


def metric_series(rounds: DataFrame, metrics: Iterable[str], run: str = "run_name") -> DataFrame:
    """``(run, round, metric, value)`` for plotting; rounds without a value are left out."""
    present = [name for name in metrics if name in rounds.columns]
    typed = rounds.select(run, "round", *[F.col(name).cast("double").alias(name) for name in present])
    return typed.unpivot([run, "round"], present, "metric", "value").where(F.col("value").isNotNull())


def defense_signal(rounds: DataFrame, run: str = "run_name") -> DataFrame:
    """``(run, round, signal, value)``: the first defence signal a run has logged, else its accuracy.

    All runs are handled in one pass: counts of logged values per run decide, and one row per run is joined back.
    """
    present = [name for name in DEFENSE_SIGNALS if name in rounds.columns]
    choice = F.lit(NO_SIGNAL)
    counts = rounds.groupBy(run).agg(*[F.count(name).alias(name) for name in present], F.count(F.lit(1)).alias("_rows"))
    for name in reversed(present):
        choice = F.when(F.col(name) > 0, F.lit(name)).otherwise(choice)
    chosen = counts.select(run, choice.alias("signal"))
    value = F.lit(None).cast("double")
    for name in [*present, NO_SIGNAL]:
        value = F.when(F.col("signal") == name, F.col(name).cast("double")).otherwise(value)
    return join_checked(rounds, settle(chosen), [run]).select(run, "round", "signal", value.alias("value"))


def feedback_summary(feedback: DataFrame, keys: Sequence[str] = ("run_name",)) -> DataFrame:
    """Share of dropped updates, mean trust of used and dropped ones, and their distance.

    A missing ``used`` counts as used; rows without trust count for the drop rate only.
    """
    used = F.coalesce(F.col("used"), F.lit(True))
    means = feedback.groupBy(*keys).agg(
        (1.0 - F.avg(used.cast("double"))).alias("drop_rate"),
        F.avg(F.when(used, F.col("trust"))).alias("trust_used_mean"),
        F.avg(F.when(~used, F.col("trust"))).alias("trust_dropped_mean"),
    )
    return means.withColumn("trust_separation", F.col("trust_used_mean") - F.col("trust_dropped_mean"))


def attacker_rank(
    feedback: DataFrame, attackers: DataFrame, k: int, keys: Sequence[str] = ("run_name", "round")
) -> DataFrame:
    """How attackers rank by trust, over all rounds.

    ``attackers`` is a table of ``client_id`` (and of some of ``keys``, when attackers differ by run). Gives the share
    of attacker rows among the ``k`` least trusted of their round, and the mean trust of attackers and others. The
    limit of each round's k least trusted is joined to the feedback, which is then summed up in one pass.
    """
    keys = list(keys)
    on = [name for name in (*keys, "client_id") if name in attackers.columns]
    marked_by = settle(attackers.select(*on).distinct().withColumn("attacker", F.lit(True)))
    trusted = feedback.where(F.col("trust").isNotNull()).select(*keys, "client_id", "trust")
    limits = settle(smallest_limit(trusted, keys, "trust", "client_id", k))
    marked = join_checked(join_checked(trusted, limits, keys), marked_by, on, "left")
    marked = marked.withColumn("attacker", F.coalesce("attacker", F.lit(False)))
    totals = marked.agg(
        F.count_if("attacker").alias("attacker_rows"),
        F.count_if(F.col("attacker") & (F.struct("trust", "client_id") <= F.col("_limit"))).alias("hits"),
        F.avg(F.when(F.col("attacker"), F.col("trust"))).alias("attacker_trust_mean"),
        F.avg(F.when(~F.col("attacker"), F.col("trust"))).alias("benign_trust_mean"),
    )
    share = F.col("hits") / F.nullif(F.col("attacker_rows").cast("double"), F.lit(0.0))
    return totals.select(
        "attacker_rows", "hits", share.alias("bottom_share"), "attacker_trust_mean", "benign_trust_mean"
    )
