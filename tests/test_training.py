"""Training: models learn, states move on from round to round, and defences hold against poisoned clients."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.operators import materialize, trust, updates
from trustframe.plans import learners, mlp, training
from trustframe.plans.scenarios import ScenarioTable, flip_draw
from trustframe.sources import runs

COLUMNS = learners.Columns(("a", "b"))


@pytest.fixture(scope="module")
def data(spark):
    """Four clients; the sign of a + b decides the label."""
    u = lambda tag: (F.pmod(F.xxhash64(F.col("id"), F.lit(tag)), F.lit(10007)) / 10007.0 - 0.5) * 4
    rows = spark.range(2400).select(
        F.col("id").cast("string").alias("row_id"), (F.col("id") % 4 + 1).alias("client_id"), u("a").alias("a"), u("b").alias("b")
    ).withColumn("y", (F.col("a") + F.col("b") > 0).cast("int")).cache()
    return rows.where("row_id < '7'"), rows.where("row_id >= '7'")


def run(data, merge=trust.MergeConfig(), rounds=3, learner=learners.LinearLearner(lr=1.0), scenarios=(learners.Scenario(),), layers=None, log=None):
    config = training.TrainConfig(rounds, 7, learner, merge)
    return training.train_rounds(*data, COLUMNS, config, scenarios, layers, log)


def tables(result):
    """Rounds, feedback and states as plain rows, whatever the order of rows and columns."""
    plain = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    return [plain(result.rounds), plain(result.feedback), plain(result.states)]


def test_states_change_and_accuracy_is_high(data):
    result = run(data)
    states = [r["weights"] for r in result.states.orderBy("round").collect()]
    assert len(states) == 4 and states[0] == [0.0, 0.0, 0.0]
    assert all(a != b for a, b in zip(states, states[1:]))
    rows = result.rounds.orderBy("round").collect()
    assert [r["round"] for r in rows] == [1, 2, 3]
    assert rows[-1]["accuracy"] > 0.95
    assert result.final().first()["round"] == 3
    feedback = result.feedback.collect()
    assert len(feedback) == 12 and all(r["used"] and r["trust"] is None for r in feedback)
    assert all(r["loss_stability"] == 1.0 for r in feedback)


def test_first_round_equals_numpy(data):
    train = data[0].toPandas()
    x = np.column_stack([train.a, train.b, np.ones(len(train))])
    expected = np.zeros(3)
    for _, rows in train.groupby("client_id"):
        w = np.zeros(3)
        for _ in range(2):
            p = 1 / (1 + np.exp(-x[rows.index] @ w))
            w -= 0.5 * x[rows.index].T @ (p - rows.y) / len(rows)
        expected += w * len(rows) / len(train)
    state = run(data, rounds=1, learner=learners.LinearLearner(0.5, steps=2)).states.where("round = 1").first()["weights"]
    assert state == pytest.approx(expected.tolist())


@pytest.mark.parametrize("merge", [
    trust.MergeConfig("fedavg"),
    trust.MergeConfig("cosine", drop_k=1, alpha=1.0, beta=0.5, gamma=0.5),
    trust.MergeConfig("trimmed_mean", clip_norm=5.0, trim_ratio=0.25),
    trust.MergeConfig("median"),
])
def test_strategies_with_a_poisoned_client(spark, data, merge):
    layers = spark.createDataFrame([(i, 0.5) for i in range(1, 5)], "client_id long, score double")
    scenarios = [learners.Scenario(0), learners.Scenario(1, (2,), 1.0)]
    result = run(data, merge, rounds=1, scenarios=scenarios, layers=layers)
    rows = {r["scenario_id"]: r for r in result.rounds.collect()}
    assert all(0 <= r[name] <= 1 for r in rows.values() for name in ("accuracy", "f1", "precision", "recall"))
    assert rows[0]["accuracy"] > 0.9 and rows[1]["accuracy"] > 0.9
    feedback = result.feedback.where("scenario_id = 1").orderBy("client_id").collect()
    assert len(feedback) == 4 and all(r["cross_layer"] == 0.5 for r in feedback)
    assert feedback[1]["loss_stability"] < 1.0
    if merge.strategy == "cosine":
        assert [r["used"] for r in feedback] == [True, False, True, True]
        assert rows[1]["dropped_clients"] == 1.0 and rows[1]["trust_min"] < 0.5
    else:
        assert all(r["used"] for r in feedback) and rows[1]["trust_mean"] is None


def test_a_cut_run_goes_on_after_its_last_complete_round(spark, data, tmp_path):
    merge = trust.MergeConfig("cosine", drop_k=1, beta=0.5)
    scenarios = [learners.Scenario(0), learners.Scenario(1, (2,), 0.4)]
    layers = spark.createDataFrame([(i, 0.2 * i) for i in range(1, 5)], "client_id long, score double")
    whole = run(data, merge, 2, scenarios=scenarios, layers=layers)
    store = runs.RunStore(spark, str(tmp_path))
    log = training.RunLog(store, "cut")
    first = run(data, merge, 1, scenarios=scenarios, layers=layers, log=log)
    assert first.rounds.count() == 2 and first.feedback.count() == 8 and first.states.count() == 4
    # Round 2 stops after its feedback and scores were written, but not its states.
    lost = spark.createDataFrame([(s, 2, 9, 0.0) for s in (0, 1)], "scenario_id long, round int, client_id long, trust double")
    store.log_feedback("cut", lost.where("client_id < 0"), sequence=2)
    store.log_rounds("cut", spark.createDataFrame([(0, 2, 0.123)], "scenario_id long, round int, accuracy double"), sequence=2)
    resumed = run(data, merge, 2, scenarios=scenarios, layers=layers, log=log)
    assert tables(resumed) == tables(whole)
    assert resumed.rounds.count() == 4 and resumed.states.count() == 6  # one row each, whatever was tried before
    with pytest.raises(ValueError, match="another configuration"):
        run(data, merge, 2, scenarios=scenarios[:1], layers=layers, log=log)
    none = run(data, merge, 0, log=training.RunLog(store, "none"))
    assert none.rounds.first()["recall"] == 1.0 and none.states.count() == 1


def test_two_thousand_scenarios(spark, data):
    """All share the first state, so one round trains each client once for each flip rate; plans do not grow."""
    picked = spark.range(2000).select(F.col("id").cast("int").alias("scenario_id"))
    attackers = picked.where("scenario_id % 2 = 1").select("scenario_id", F.lit(2).cast("long").alias("client_id"), F.lit(1.0).alias("flip_rate"))
    table = ScenarioTable.from_tables(picked, attackers)
    result = run(data, rounds=1, scenarios=table)
    rows = result.rounds.collect()
    few = {r["scenario_id"]: r for r in run(data, rounds=1, scenarios=[learners.Scenario(0), learners.Scenario(1, (2,), 1.0)]).rounds.collect()}
    assert len(rows) == 2000
    assert all(r["accuracy"] == few[r["scenario_id"] % 2]["accuracy"] for r in rows)


def test_poisoned_sums_equal_flipped_labels(spark, data):
    """Two attackers with different rates in one scenario, and one client with several rates over all scenarios."""
    train = data[0]
    rows = [(0, 1, 0.3), (0, 2, 1.0), (1, 1, 0.7), (2, 1, 0.3), (3, 3, 1e-9)]
    ids = spark.createDataFrame([(i,) for i in range(5)], "scenario_id int")
    table = ScenarioTable.from_tables(ids, spark.createDataFrame(rows, "scenario_id int, client_id long, flip_rate double"))
    state = ids.select("scenario_id", F.array(F.lit(0.1) * F.col("scenario_id"), F.lit(-0.2), F.lit(0.05)).alias("weights"))
    learner = learners.LinearLearner(0.5, steps=2)
    got = {(r["scenario_id"], r["client_id"]): r for r in learner.train(train, COLUMNS, state, table, 3, 11).collect()}
    assert len(got) == 20
    rates = {(s, c): rate for s, c, rate in rows}
    drawn = train.withColumn("u", flip_draw(F.col("row_id"), F.col("client_id"), 3, 11)).toPandas()
    for (scenario, client), row in got.items():
        own = drawn[drawn.client_id == client]
        x = np.column_stack([own.a, own.b, np.ones(len(own))])
        target = np.where(own.u < rates.get((scenario, client), 0.0), 1 - own.y, own.y)
        start = np.array([0.1 * scenario, -0.2, 0.05])
        w = start.copy()
        for _ in range(2):
            w = w - 0.5 * x.T @ (1 / (1 + np.exp(-x @ w)) - target) / len(own)
        assert row["values"] == pytest.approx((w - start).tolist(), abs=1e-12)
        assert row["weight"] == len(own)


def test_states_beyond_the_broadcast_limit(spark, data, monkeypatch):
    learner, limit = learners.LinearLearner(0.5, steps=2), 400
    states = spark.range(6).select(F.col("id").cast("int").alias("scenario_id"), F.lit(1).alias("round"), F.array(F.sin("id"), F.cos("id"), F.lit(0.1)).alias("weights"))
    count = lambda s, **o: sorted(map(tuple, learner.predictions(data[1], COLUMNS, s, **o).collect()))
    small = count(materialize.settle(states))
    assert count(materialize.Settled(materialize.cut_lineage(states), False), block_bytes=limit) == small
    scenarios = [learners.Scenario(i, (2,), 0.5) for i in range(6)]
    want = sorted(map(str, learner.train(data[0], COLUMNS, states, scenarios, 1, 1).collect()))
    monkeypatch.setattr(materialize, "BROADCAST_LIMIT_BYTES", limit)
    monkeypatch.setattr(materialize, "ARRAY_ROWS", 3)
    got = sorted(map(str, learner.train(data[0], COLUMNS, states, scenarios, 1, 1).collect()))
    rounded = lambda rows: [re.sub(r"(\d\.\d{9})\d+", r"\1", row) for row in rows]
    assert rounded(got) == rounded(want)


def test_updates_that_cannot_be_merged_raise(spark):
    schema = "scenario_id int, round int, client_id long, weight double, values array<double>"
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    good = frame((0, 1, 1, 1.0, [1.0, 2.0]), (0, 1, 2, 0.0, [1.0, 2.0]), (1, 1, 1, 2.0, [1.0]))
    assert updates.checked_updates(good).count() == 3
    for bad, why in ((frame(), "no client updates"), (frame((0, 1, 1, 1.0, [1.0]), (0, 1, 2, 1.0, [1.0, 2.0])), "same length"), (frame((0, 1, 1, 0.0, [1.0])), "greater than 0")):
        for strategy in ("fedavg", "median", "trimmed_mean", "cosine"):
            with pytest.raises(ValueError, match=why):
                trust.merge_updates(bad, trust.MergeConfig(strategy))


def test_no_rounds_scores_the_initial_model(data):
    result = run(data, rounds=0)
    row = result.rounds.first()
    assert row["round"] == 0 and row["recall"] == 1.0
    assert result.feedback.count() == 0


def test_mlp_gradient_matches_differences():
    rng = np.random.default_rng(0)
    hidden, x, y = (5, 4), rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float)
    state = mlp.initial_state(3, hidden, 1)
    assert len(state) == mlp.state_size(3, hidden)
    slope = mlp.gradient(state, x, y, hidden)
    for i in range(0, len(state), 5):
        step = np.zeros_like(state)
        step[i] = 1e-6
        numeric = (mlp.mean_loss(state + step, x, y, hidden) - mlp.mean_loss(state - step, x, y, hidden)) / 2e-6
        assert slope[i] == pytest.approx(numeric, abs=1e-6)


def test_mlp_rounds(data):
    learner = learners.MlpLearner(hidden=(16, 8), lr=0.01, epochs=3, batch_size=64)
    result = run(data, rounds=2, learner=learner, scenarios=[learners.Scenario(0), learners.Scenario(5, (1,), 0.5)])
    rows = {(r["scenario_id"], r["round"]): r["accuracy"] for r in result.rounds.collect()}
    assert set(rows) == {(0, 1), (0, 2), (5, 1), (5, 2)}
    assert rows[(0, 2)] > 0.9
    assert rows == {(r["scenario_id"], r["round"]): r["accuracy"] for r in result.rounds.collect()}


def test_large_clients_are_trained_in_parts(spark, data):
    train = data[0]
    learner = learners.MlpLearner(hidden=(8, 4), lr=0.01, rows_per_task=100)
    state = spark.createDataFrame([(0, learner.initial(COLUMNS, 1))], "scenario_id int, weights array<double>")
    rows = learner.train(train, COLUMNS, state, [learners.Scenario()], 1, 1).collect()
    sizes = {r["client_id"]: r["count"] for r in train.groupBy("client_id").count().collect()}
    assert {r["client_id"]: r["weight"] for r in rows} == sizes
    assert all(len(r["values"]) == mlp.state_size(2, (8, 4)) and r["loss_after"] < r["loss_before"] for r in rows)


def test_sweep(data):
    config = training.TrainConfig(1, 3, learners.LinearLearner(1.0))
    rows = training.attacker_sweep(*data, COLUMNS, [3, 0, 9], 1.0, config).collect()
    assert [r["n_attackers"] for r in rows] == [0, 3, 9]
    assert [len(r["malicious_clients"]) for r in rows] == [0, 3, 4]
    assert rows[0]["accuracy"] > 0.9 and rows[2]["accuracy"] < 0.1
    assert {r["n_clients"] for r in rows} == {4}
    with pytest.raises(ValueError):
        training.attacker_sweep(*data, COLUMNS, [], 1.0, config)


def test_baselines(data):
    train, test = data
    row = training.baseline_binary(train, test, ["a", "b"]).first()
    assert row["accuracy"] > 0.95 and row["f1"] > 0.95
    name = F.when(F.col("y") == 1, "attack").otherwise("normal")
    named = lambda df, other=None: df.withColumn("label", name if other is None else F.when(F.col("a") > 1.9, other).otherwise(name))
    full = training.baseline_multiclass(named(train), named(test), ["a", "b"]).first()
    unseen = training.baseline_multiclass(named(train), named(test, "novel"), ["a", "b"]).first()
    assert full["accuracy"] > 0.95 and unseen["accuracy"] < full["accuracy"]


def test_baseline_equals_newton(data):
    """The penalised optimum is unique, so predictions can be checked against a direct solver."""
    train, test = (df.toPandas() for df in data)
    design = lambda rows: np.column_stack([rows.a, rows.b, np.ones(len(rows))])
    x, y, w = design(train), train.y.to_numpy(), np.zeros(3)
    penalty = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (p - y) + penalty @ w)
    guess = design(test) @ w >= 0
    row = training.baseline_binary(*data, ["a", "b"]).first()
    assert abs(row["tp"] - int(np.sum(guess & (test.y == 1)))) <= 1
    assert abs(row["fp"] - int(np.sum(guess & (test.y == 0)))) <= 1


def test_local_mlp_equals_the_same_steps_outside_spark(spark, data):
    train = data[0]
    learner = learners.MlpLearner(hidden=(6, 4), lr=0.01, epochs=2, batch_size=32)
    start = learner.initial(COLUMNS, 1)
    state = spark.createDataFrame([(0, start)], "scenario_id int, weights array<double>")
    rows = {r["client_id"]: r for r in learner.train(train, COLUMNS, state, [learners.Scenario(0, (2,), 1.0)], 4, 9).collect()}
    ordered = train.withColumn("_order", F.xxhash64("row_id")).orderBy("_order").toPandas()
    for client in (1, 2):
        own = ordered[ordered.client_id == client]
        x, y = own[["a", "b"]].to_numpy(), own.y.to_numpy().astype(float)
        target = 1 - y if client == 2 else y
        end = mlp.train(np.array(start), x, target, (6, 4), 2, 32, 0.01, 0.0, [9, 4, client, 0])
        assert rows[client]["values"] == pytest.approx((end - np.array(start)).tolist(), abs=1e-12)
        assert rows[client]["loss_after"] == pytest.approx(mlp.mean_loss(end, x, y, (6, 4)))
        assert rows[client]["loss_before"] == pytest.approx(mlp.mean_loss(np.array(start), x, y, (6, 4)))


def test_rows_held_in_memory_change_no_result(spark, data):
    found = []
    for limit in (100, 100_000):  # below and above the rows of a client
        learner = learners.MlpLearner(hidden=(8, 4), lr=0.01, batch_size=32, epochs=2, rows_per_task=limit)
        state = spark.createDataFrame([(0, learner.initial(COLUMNS, 1))], "scenario_id int, weights array<double>")
        rows = learner.train(data[0], COLUMNS, state, [learners.Scenario(0, (2,), 0.5)], 1, 1).collect()
        found.append(sorted(tuple(r) for r in rows))
    assert len(found[0]) == 4 and found[0] == found[1]


def test_many_states_are_scored_in_slices(spark, data, monkeypatch):
    monkeypatch.setattr(learners, "STATE_SLICE", 2)
    learner = learners.MlpLearner(hidden=(8, 4))
    states = [(s, r, learner.initial(COLUMNS, 10 * s + r)) for s in range(2) for r in range(1, 4)]
    frame = spark.createDataFrame(states, "scenario_id int, round int, weights array<double>")
    count = lambda small: sorted(map(tuple, learner.predictions(data[1], COLUMNS, materialize.Settled(frame, small)).collect()))
    assert len(count(True)) == 24 and count(False) == count(True)


def test_many_states_are_scored_by_one_plan(spark):
    """Plans do not grow with the blocks; counts of null, infinite and missing values are those of the broadcast."""
    values = [None, float("nan"), float("inf"), 0.0, -1.5, 2.0]
    rows = spark.createDataFrame([(a, b, y) for a in values for b in values for y in (0, 1, None)], "a double, b double, y int")
    listed = [(i % 37, 1, [0.1 * i - 2.0, values[i % 6], 0.5]) for i in range(60)] + [(40, 1, None), (41, 2, [0.0, 0.0, 0.0])]
    states = spark.createDataFrame(listed, "scenario_id int, round int, weights array<double>")
    score = lambda held, **o: learners.LinearLearner().predictions(rows, COLUMNS, held, **o)
    want = sorted(map(str, score(materialize.Settled(states, True)).collect()))
    large = materialize.Settled(materialize.cut_lineage(states), False)
    plans = [score(large, block_bytes=limit) for limit in (4096, 64)]
    assert [sorted(map(str, plan.collect())) for plan in plans] == [want, want]
    assert all(plan.dtypes == score(materialize.Settled(states, True)).dtypes for plan in plans)
    sizes = [len(plan._jdf.queryExecution().optimizedPlan().toString().split("\n")) for plan in plans]
    assert sizes[0] == sizes[1]


def test_boxes_count_what_all_rows_give(spark):
    """Trees of boxes give the counts of the broadcast, in several parts of rows, and read few of the rows."""
    u = lambda tag, n: F.pmod(F.xxhash64(F.col("id"), F.lit(tag)), F.lit(n)) / float(n) - 0.5
    rows = spark.range(6000).select(u("a", 10007).alias("a"), u("b", 5).alias("b"), (F.col("id") % 2).cast("int").alias("y")).repartition(3)
    states = spark.range(300).select(
        F.col("id").cast("int").alias("scenario_id"), F.lit(1).alias("round"), F.array(u("u", 997), u("v", 991), u("w", 97)).alias("weights")
    )
    score = lambda held: sorted(map(str, learners.LinearLearner().predictions(rows, COLUMNS, held).collect()))
    want, large = score(materialize.Settled(states, True)), materialize.Settled(materialize.cut_lineage(states), False)
    assert score(large) == want
    old, learners.PART_BYTES = learners.PART_BYTES, 16_384  # six parts of rows
    try:
        assert score(large) == want
    finally:
        learners.PART_BYTES = old
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(2, 60_000)), rng.normal(size=(50, 3))
    x[0, ::9000], x[1, 7] = np.inf, np.nan
    w[3], w[4, 1], w[5] = 0.0, np.inf, [1e308, 1e308, -1e308]
    boxes, read = learners._Boxes.of(x, np.ones(2)), []
    summed = learners._summed
    learners._summed = lambda terms: read.append(terms[0].shape) or summed(terms)
    try:
        found = boxes.ones(w[6:])
    finally:
        learners._summed = summed
    with np.errstate(all="ignore"):
        assert boxes.ones(w).tolist() == [int(np.sum(~(summed([v[0] * x[0], v[1] * x[1], v[2:]]) <= learners.HALF_BELOW))) for v in w]
    assert found.tolist() == boxes.ones(w)[6:].tolist()
    assert sum(np.prod(shape) for shape in read) < 0.2 * 60_000 * 44
