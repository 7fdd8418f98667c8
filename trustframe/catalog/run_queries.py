"""Queries on run logs and client feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trustframe.catalog import update_queries
from trustframe.catalog.standins import RUN_LOG_SQL, SEED, r6, run_log, updates_sql
from trustframe.operators.noise import pick_clients
from trustframe.operators.materialize import scratch_path
from trustframe.plans import analytics
from trustframe.sources import runs
from trustframe.sources.upsert import highest

WANTED = tuple(f"run_{i}" for i in (1, 2, 3, 5, 8, 13, 21, 100_000_000))
ATTACKERS = 40
BOTTOM = 5


def round_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds as left by replacing a row whenever its round is logged again."""
    rows = run_log(spark, sf_dir)
    return runs.latest_rounds(rows, tie=["event_id"]).select("run_name", "round", "accuracy", "event_id")


def round_upsert_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds upserted into a store in three writes, one of them tried twice and one late, keyed by scenario too."""
    rows = run_log(spark, sf_dir).select(
        (F.length("event_type") % 2).alias("scenario_id"), "round", "logged_at", "accuracy",
        F.col("event_id").alias("sequence"), F.pmod("event_id", F.lit(3)).alias("write"),
    )
    rows = rows.where("scenario_id IS NOT NULL")
    store = runs.RunStore(spark, scratch_path(spark, "store"))
    for write in (1, 2, 2, 0):  # rows of write 0 may be older than what is there
        store.log_rounds("run", highest(rows.where(F.col("write") == write).drop("write"), ["scenario_id", "round"], ["sequence"]))
    moment = F.col("logged_at").cast("timestamp_ntz").alias("logged_at")
    return store.rounds().select("run_name", "scenario_id", "round", moment, "accuracy")


def feedback_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each round, put together from small parts."""
    messages = runs.feedback_messages(_feedback(spark, sf_dir), ["round"], clients_per_part=20)
    parsed = messages.select("n_clients", F.from_json("value", f"round bigint, clients array<{runs.CLIENT_SCHEMA}>").alias("m"))
    sorted_ids = F.transform("m.clients", lambda c: c["client_id"])
    return parsed.select(
        F.col("m.round").alias("round"), "n_clients", F.aggregate(sorted_ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"),
        (sorted_ids == F.array_sort(sorted_ids)).alias("in_order"),
        F.size(F.filter("m.clients", lambda c: ~c["used"])).cast("long").alias("n_dropped"),
    )


def latest_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for logs without a round, where each run becomes one point."""
    rows = run_log(spark, sf_dir).drop("round")
    return runs.latest_rounds(rows, tie=["event_id"]).select("run_name", "round", "logged_at", "event_id")


def final_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = runs.latest_rounds(run_log(spark, sf_dir), tie=["event_id"])
    return analytics.final_rounds(latest, tie=["event_id"]).select("run_name", "round", "accuracy", "event_id")


def _strategy_logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Five logs with different columns, one row per round each; together they hold every event."""
    rows = run_log(spark, sf_dir).drop("run_name")
    kind = F.coalesce("event_type", F.lit(""))
    pick = lambda chosen: rows.where(chosen).drop("event_type", "event_id")
    shares = {"loss_stability_mean": 1 / (1 + F.col("accuracy")), "cross_layer_mean": F.when(F.col("round") > 5, 0.5)}
    return {
        "plain": pick(~kind.isin("click", "error", "purchase", "signup")),
        "trusting": pick(kind == "click").withColumn("trust_mean", F.col("accuracy") / 100),
        "stable": pick(kind == "error").withColumns(shares),
        "buying": pick(kind == "purchase").withColumn("dropped_clients", F.floor("accuracy").cast("double")),
        "joining": pick(kind == "signup").withColumn("trust_mean", F.col("accuracy") / 200),
    }


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.merge_runs(_strategy_logs(spark, sf_dir))


def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _merged(spark, sf_dir)
    numbers = ["accuracy", "trust_mean", "loss_stability_mean", "cross_layer_mean", "dropped_clients"]
    return merged.select("run_name", "round", "logged_at", *[r6(F.col(c)).alias(c) for c in numbers])


def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = analytics.metric_series(_merged(spark, sf_dir), ["accuracy", "recall", "trust_mean", "cross_layer_mean"])
    return series.select("run_name", "round", "metric", r6(F.col("value")).alias("value"))


def defense_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = analytics.defense_signal(_merged(spark, sf_dir))
    return chosen.select("run_name", "round", "signal", r6(F.col("value")).alias("value"))


def run_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = analytics.select_runs(run_log(spark, sf_dir), WANTED)
    return chosen.groupBy("run_name").agg(F.count(F.lit(1)).alias("n"), F.max("round").alias("last_round"))


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update_queries._feedback(spark, sf_dir).withColumnRenamed("label", "round")


def feedback_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback nested by round, written as JSON and read back."""
    texts = runs.feedback_json(runs.nest_feedback(_feedback(spark, sf_dir), ["round"], clients_per_row=20))
    parsed = texts.select(F.from_json("value", f"round bigint, clients array<{runs.CLIENT_SCHEMA}>").alias("m")).select("m.*")
    return runs.explode_feedback(parsed).groupBy("round").agg(
        F.count(F.lit(1)).alias("n_clients"), F.count_if(~F.col("used")).alias("n_dropped"), F.sum("client_id").alias("ids")
    )


def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = analytics.feedback_summary(_feedback(spark, sf_dir), ["round"])
    return summary.select("round", *[r6(F.col(c)).alias(c) for c in summary.columns if c != "round"])


def attacker_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    feedback = _feedback(spark, sf_dir)
    ranked = analytics.attacker_rank(feedback, pick_clients(feedback, ATTACKERS, SEED), BOTTOM, ["round"])
    shares = ["bottom_share", "attacker_trust_mean", "benign_trust_mean"]
    return ranked.select("attacker_rows", "hits", *[r6(F.col(c)).alias(c) for c in shares])


QUERIES = {
    query.__name__: query
    for query in (
        round_upsert, round_upsert_store, feedback_messages, latest_round, final_round, merge_runs, metric_series, defense_signal, run_select, feedback_nested,
        feedback_summary, attacker_rank,
    )
}

_MERGED = f"""{RUN_LOG_SQL},
named AS (
  SELECT CASE event_type WHEN 'click' THEN 'trusting' WHEN 'error' THEN 'stable' WHEN 'purchase' THEN 'buying'
                         WHEN 'signup' THEN 'joining' ELSE 'plain' END AS run_name,
         round, logged_at, accuracy
  FROM log),
merged AS (
  SELECT run_name, round, logged_at, accuracy,
         CASE run_name WHEN 'trusting' THEN accuracy / 100 WHEN 'joining' THEN accuracy / 200 END AS trust_mean,
         CASE WHEN run_name = 'stable' THEN 1 / (1 + accuracy) END AS loss_stability_mean,
         CASE WHEN run_name = 'stable' AND round > 5 THEN 0.5::DOUBLE END AS cross_layer_mean,
         CASE WHEN run_name = 'buying' THEN floor(accuracy)::DOUBLE END AS dropped_clients
  FROM named QUALIFY row_number() OVER (PARTITION BY run_name, round ORDER BY logged_at DESC) = 1)"""
_LATEST = f"""{RUN_LOG_SQL},
latest AS (SELECT * FROM log
           QUALIFY row_number() OVER (PARTITION BY run_name, round ORDER BY logged_at DESC, event_id DESC) = 1)"""
_FLAGGED = f"{updates_sql()}, {update_queries._SCORED}"

ORACLES = {
    "round_upsert": f"WITH {_LATEST} SELECT run_name, round, accuracy, event_id FROM latest",
    "round_upsert_store": f"""
WITH {RUN_LOG_SQL}
SELECT 'run' AS run_name, length(event_type) % 2 AS scenario_id, round, logged_at, accuracy FROM log
WHERE event_type IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY length(event_type) % 2, round ORDER BY event_id DESC) = 1""",
    "feedback_messages": f"""
WITH {_FLAGGED} SELECT label AS round, count(*) AS n_clients, sum(client_id)::BIGINT AS ids, true AS in_order,
       count(*) FILTER (NOT used) AS n_dropped
FROM flagged GROUP BY label""",
    "latest_round": f"""
WITH {RUN_LOG_SQL} SELECT run_name, 1 AS round, logged_at, event_id FROM log
QUALIFY row_number() OVER (PARTITION BY run_name ORDER BY logged_at DESC, event_id DESC) = 1""",
    "final_round": f"""
WITH {_LATEST} SELECT run_name, round, accuracy, event_id FROM latest
QUALIFY row_number() OVER (PARTITION BY run_name ORDER BY round DESC) = 1""",
    "merge_runs": f"""
WITH {_MERGED} SELECT run_name, round, logged_at, round(accuracy, 6) + 0.0 AS accuracy,
       round(trust_mean, 6) + 0.0 AS trust_mean, round(loss_stability_mean, 6) + 0.0 AS loss_stability_mean,
       round(cross_layer_mean, 6) + 0.0 AS cross_layer_mean, round(dropped_clients, 6) + 0.0 AS dropped_clients
FROM merged""",
    "metric_series": f"""
WITH {_MERGED}, long AS (
  SELECT run_name, round, 'accuracy' AS metric, accuracy AS value FROM merged
  UNION ALL SELECT run_name, round, 'trust_mean', trust_mean FROM merged
  UNION ALL SELECT run_name, round, 'cross_layer_mean', cross_layer_mean FROM merged)
SELECT run_name, round, metric, round(value, 6) + 0.0 AS value FROM long WHERE value IS NOT NULL""",
    "defense_signal": f"""
WITH {_MERGED}
SELECT run_name, round, CASE run_name WHEN 'trusting' THEN 'trust_mean' WHEN 'joining' THEN 'trust_mean'
                        WHEN 'buying' THEN 'dropped_clients' WHEN 'stable' THEN 'loss_stability_mean'
                        ELSE 'accuracy' END AS signal,
       round(CASE run_name WHEN 'trusting' THEN trust_mean WHEN 'joining' THEN trust_mean
             WHEN 'buying' THEN dropped_clients WHEN 'stable' THEN loss_stability_mean ELSE accuracy END, 6) + 0.0 AS value
FROM merged""",
    "run_select": f"""
WITH {RUN_LOG_SQL} SELECT run_name, count(*) AS n, max(round) AS last_round FROM log
WHERE run_name IN {WANTED} GROUP BY run_name""",
    "feedback_nested": f"""
WITH {_FLAGGED} SELECT label AS round, count(*) AS n_clients, count(*) FILTER (NOT used) AS n_dropped,
       sum(client_id)::BIGINT AS ids
FROM flagged GROUP BY label""",
    "feedback_summary": f"""
WITH {_FLAGGED}, m AS (
  SELECT label AS round, 1 - avg(used::INTEGER) AS drop_rate, avg(trust) FILTER (used) AS u, avg(trust) FILTER (NOT used) AS d
  FROM flagged GROUP BY label)
SELECT round, round(drop_rate, 6) + 0.0 AS drop_rate, round(u, 6) + 0.0 AS trust_used_mean,
       round(d, 6) + 0.0 AS trust_dropped_mean, round(u - d, 6) + 0.0 AS trust_separation
FROM m""",
    "attacker_rank": f"""
WITH {_FLAGGED}, bad AS (
  SELECT client_id FROM (SELECT DISTINCT vec_id AS client_id FROM embeddings)
  ORDER BY md5(concat('{SEED}:', client_id)), client_id LIMIT {ATTACKERS}),
r AS (SELECT *, client_id IN (SELECT client_id FROM bad) AS attacker,
             row_number() OVER (PARTITION BY label ORDER BY trust, client_id) AS place FROM flagged)
SELECT count(*) FILTER (attacker) AS attacker_rows, count(*) FILTER (attacker AND place <= {BOTTOM}) AS hits,
       round(count(*) FILTER (attacker AND place <= {BOTTOM})::DOUBLE / count(*) FILTER (attacker), 6) + 0.0 AS bottom_share,
       round(avg(trust) FILTER (attacker), 6) + 0.0 AS attacker_trust_mean,
       round(avg(trust) FILTER (NOT attacker), 6) + 0.0 AS benign_trust_mean
FROM r""",
}
