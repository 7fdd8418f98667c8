"""Training rounds over all clients and scenarios at once, attacker sweeps and central baselines."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, functions as F

from trustframe.functions import arrays
from trustframe.functions.scalars import format_int_list
from trustframe.operators import metrics, trust, updates
from trustframe.operators.materialize import (
    Settled,
    cut_lineage,
    join_checked,
    keep_for_iteration,
    literal_table,
    settle,
)
from trustframe.plans.learners import Columns, LinearLearner, MlpLearner
from trustframe.plans.scenarios import Scenario, ScenarioTable, picked_attackers, scenario_table
from trustframe.sources.runs import RunStore

KEYS = ["scenario_id", "round"]


@dataclass(frozen=True)
class TrainConfig:
    """What a run is made of; ``learner`` decides how clients train, ``merge`` how their updates are combined."""

    rounds: int = 5
    seed: int = 1337
    learner: LinearLearner | MlpLearner = field(default_factory=LinearLearner)
    merge: trust.MergeConfig = field(default_factory=trust.MergeConfig)

    def as_dict(self) -> dict:
        return {**asdict(self), "learner_kind": type(self.learner).__name__}


@dataclass(frozen=True)
class TrainResult:
    """``rounds``: metrics and diagnostics per scenario and round. ``feedback``: one row per client and round.
    ``states``: the common model before the first round (round 0) and after each round."""

    rounds: DataFrame
    feedback: DataFrame
    states: DataFrame

    def final(self) -> DataFrame:
        """Metrics of the last round of each scenario."""
        rest = [F.col(name) for name in self.rounds.columns if name != "scenario_id"]
        last = self.rounds.groupBy("scenario_id").agg(F.max_by(F.struct(*rest), "round").alias("_last"))
        return last.select("scenario_id", "_last.*")


@dataclass(frozen=True)
class RunLog:
    """Where a run is logged, round by round. A run of this name that was cut goes on after its last complete round."""

    store: RunStore
    run_name: str


def train_rounds(
    rows: DataFrame,
    test: DataFrame,
    columns: Columns,
    config: TrainConfig = TrainConfig(),
    scenarios: Sequence[Scenario] | ScenarioTable = (Scenario(),),
    cross_layer: DataFrame | None = None,
    log: RunLog | None = None,
) -> TrainResult:
    """Train, diagnose, merge and install, round by round, and score the rounds on ``test``.

    ``rows`` and ``test`` hold prepared features. ``cross_layer`` is ``(client_id, score)``; it depends on raw data
    only, so it is worked out once. The updates of each round are written and checked before they are merged, and the
    merged state is settled, so the plan of a round does not contain the rounds before it. With no rounds the initial
    model is scored as round 0.

    Without ``log`` all rounds are scored in one pass at the end. With it every round writes its feedback, its scores
    and its states before the next one starts, each of them once however often a round is tried, and the result is
    read from the log. More rounds may be asked of a run later; anything else of its configuration has to stay.
    """
    rows = keep_for_iteration(
        rows.select(columns.row_id, columns.client, columns.label, *[f"`{name}`" for name in columns.features])
    )
    table = scenario_table(rows.sparkSession, scenarios)
    loop = _Loop(rows, test, columns, config, table, _settled_layers(cross_layer))
    try:
        return loop.run() if log is None else loop.run_logged(log)
    finally:
        rows.unpersist()


def _settled_layers(cross_layer: DataFrame | None) -> Settled | None:
    if cross_layer is None:
        return None
    return settle(cross_layer.select(F.col("client_id").cast("long").alias("client_id"), F.col("score").alias("cross_layer")))


@dataclass(frozen=True)
class _Loop:
    rows: DataFrame
    test: DataFrame
    columns: Columns
    config: TrainConfig
    scenarios: ScenarioTable
    layers: Settled | None

    def start(self) -> DataFrame:
        first = self.config.learner.initial(self.columns, self.config.seed)
        model = literal_table(self.rows.sparkSession, [(0, first)], "round int, weights array<double>")
        return self.scenarios.ids.crossJoin(F.broadcast(model))

    def round(self, state: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """The common state after a round that starts from ``state``, and the feedback to its clients."""
        trained = self.config.learner.train(self.rows, self.columns, state, self.scenarios, number, self.config.seed)
        trained = trained.withColumns({"round": F.lit(number), "client_id": F.col("client_id").cast("long")})
        diagnosed = trained.withColumn(
            "loss_stability", trust.loss_stability(F.col("loss_before"), F.col("loss_after"))
        )
        if self.layers is not None:
            diagnosed = join_checked(diagnosed, self.layers, ["client_id"], "left")
        current = updates.checked_updates(updates.clip_updates(diagnosed, self.config.merge.clip_norm), KEYS)
        scored = trust.score_updates(current, self.config.merge, KEYS)
        merged = updates.assemble(trust.merge_scored(scored, self.config.merge, KEYS), KEYS)
        moved = state.drop("round").join(merged, "scenario_id").select(
            "scenario_id", "round", arrays.add(F.col("weights"), F.col("values")).alias("weights")
        )
        return moved, trust.client_feedback(scored, KEYS)

    def score(self, states: Settled) -> DataFrame:
        counts = self.config.learner.predictions(self.test, self.columns, states)
        return metrics.binary_metrics(counts, F.col("y"), F.col("predicted"), KEYS, count=F.col("n")).drop(
            "tp", "fp", "tn", "fn"
        )

    def run(self) -> TrainResult:
        state = settle(self.start())
        states, feedback = [state], []
        for number in range(1, self.config.rounds + 1):
            moved, told = self.round(state.df, number)
            state = settle(moved)
            states.append(state)
            feedback.append(told)
        all_states = functools.reduce(DataFrame.unionByName, [s.df for s in states])
        to_score = all_states.where("round > 0") if feedback else all_states
        few = all(s.small for s in states) and len(states) <= 64
        scores = self.score(Settled(to_score, True) if few else settle(to_score))
        if not feedback:
            return TrainResult(scores, _no_feedback(self.rows.sparkSession), all_states)
        messages = functools.reduce(DataFrame.unionByName, feedback)
        return TrainResult(scores.join(metrics.round_diagnostics(messages, KEYS), KEYS, "left"), messages, all_states)

    def run_logged(self, log: RunLog) -> TrainResult:
        store, run = log.store, log.run_name
        mark = self.fingerprint()
        last = store.last_complete(run, mark)
        if last is None:
            last = 0
            store.save_round(run, 0, self.start(), mark)
            if self.config.rounds == 0:
                store.log_rounds(run, self.score(settle(self._saved(store, run).where("round = 0"))), sequence=0)
        for number in range(last + 1, self.config.rounds + 1):
            state = settle(self._saved(store, run).where(F.col("round") == number - 1)).df
            moved, told = self.round(state, number)
            moved = settle(moved)
            told = cut_lineage(told)
            store.log_feedback(run, told, sequence=number)
            scores = self.score(moved).join(metrics.round_diagnostics(told, KEYS), KEYS, "left")
            store.log_rounds(run, scores, sequence=number)
            store.save_round(run, number, moved.df, mark)
        done = [min(self.config.rounds, 1), max(self.config.rounds, 0)]
        mine = lambda table: table.where(F.col("run_name") == run).drop("run_name", "logged_at")
        upto = lambda table: mine(table).where(F.col("round").between(*done))
        typed = lambda table: table.withColumn("scenario_id", F.col("scenario_id").cast("int"))
        told = typed(upto(store.feedback())) if self.config.rounds else _no_feedback(self.rows.sparkSession)
        states = self._saved(store, run).where(F.col("round") <= self.config.rounds)
        return TrainResult(typed(upto(store.rounds())), told, states)

    @staticmethod
    def _saved(store: RunStore, run: str) -> DataFrame:
        return store.states().where(F.col("run_name") == run).drop("run_name")

    def fingerprint(self) -> str:
        """Of all that a run must keep when it goes on: configuration without the number of rounds, and its tables."""
        fixed = {k: v for k, v in self.config.as_dict().items() if k != "rounds"} | {"columns": asdict(self.columns)}
        width = F.xxhash64(F.struct("*")).cast("decimal(38, 0)")
        sums = lambda df: tuple(df.select(F.count("*"), F.sum(width)).first())
        tables = [sums(self.scenarios.ids), sums(self.scenarios.attackers.df)]
        tables += [sums(self.layers.df)] if self.layers is not None else []
        return hashlib.sha256(json.dumps([fixed, tables], sort_keys=True, default=str).encode()).hexdigest()


def _no_feedback(spark) -> DataFrame:
    return literal_table(
        spark,
        [],
        "scenario_id int, round int, client_id long, used boolean, trust double, cosine_similarity double, "
        "loss_stability double, cross_layer double, notes string",
    )


def attacker_sweep(
    rows: DataFrame,
    test: DataFrame,
    columns: Columns,
    attackers: Sequence[int],
    flip_rate: float,
    config: TrainConfig = TrainConfig(),
    cross_layer: DataFrame | None = None,
) -> DataFrame:
    """One summary row per attacker count, from one training job in which every count is a scenario."""
    if not attackers:
        raise ValueError("attacker counts must not be empty")
    clients = settle(rows.select(F.col(columns.client).alias("client_id")).distinct()).df
    scenarios = picked_attackers(clients, attackers, flip_rate, config.seed)
    result = train_rounds(rows, test, columns, config, scenarios, cross_layer).final()
    listed = F.sort_array(F.collect_list("client_id"))
    chosen = scenarios.attackers.derive(scenarios.attackers.df.groupBy("scenario_id").agg(listed.alias("malicious_clients")))
    n_clients = clients.agg(F.count("*").alias("n_clients"))
    return (
        join_checked(result, chosen, ["scenario_id"], "left")
        .crossJoin(F.broadcast(n_clients))
        .select(
            "n_clients",
            F.col("scenario_id").alias("n_attackers"),
            F.coalesce("malicious_clients", F.array().cast("array<bigint>")).alias("malicious_clients"),
            F.lit(config.merge.strategy).alias("aggregation"),
            F.lit(float(flip_rate)).alias("label_flip_rate"),
            F.lit(config.rounds).alias("rounds"),
            "recall",
            "false_positive_rate",
            "accuracy",
            "f1",
        )
        .orderBy("n_attackers")
    )


def export_sweep(sweep: DataFrame) -> DataFrame:
    """Sweep summary with the client ids as comma separated text, as it is written to CSV."""
    return sweep.withColumn("malicious_clients", format_int_list(F.col("malicious_clients")))


def _assembled(df: DataFrame, features: Sequence[str], *keep):
    from pyspark.ml.functions import array_to_vector

    values = F.array(*[F.col(f"`{name}`").cast("double") for name in features])
    return df.select(*keep, array_to_vector(values).alias("features"))


def baseline_binary(train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "y", c: float = 1.0) -> DataFrame:
    """Central logistic regression with an L2 penalty of strength ``1 / c`` on the summed loss: one metrics row."""
    from pyspark.ml.classification import LogisticRegression

    fitted_on = keep_for_iteration(_assembled(train, features, F.col(label).cast("double").alias("label")))
    try:
        n = fitted_on.count()
        model = LogisticRegression(
            maxIter=300, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False
        ).fit(fitted_on)
    finally:
        fitted_on.unpersist()
    scored = model.transform(_assembled(test, features, F.col(label).cast("int").alias("y")))
    return metrics.binary_metrics(scored, F.col("y"), F.col("prediction").cast("int"))


def baseline_multiclass(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "label", c: float = 1.0
) -> DataFrame:
    """Central multinomial regression on raw labels: accuracy. A label that occurs in ``test`` only counts as wrong."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    fitted_on = _assembled(train, features, F.col(label).alias("name"))
    index = StringIndexer(inputCol="name", outputCol="label", stringOrderType="alphabetAsc").fit(fitted_on)
    indexed = keep_for_iteration(index.transform(fitted_on).select("label", "features"))
    try:
        n = indexed.count()
        model = LogisticRegression(
            maxIter=300, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, family="multinomial"
        ).fit(indexed)
    finally:
        indexed.unpersist()
    names = F.array(*[F.lit(name) for name in index.labels])
    scored = model.transform(_assembled(test, features, F.col(label).alias("name")))
    guessed = F.get(names, F.col("prediction").cast("int"))
    return scored.select((guessed == F.col("name")).cast("double").alias("right")).agg(
        F.count(F.lit(1)).alias("n_test"), F.avg("right").alias("accuracy")
    )
