"""Queries on client updates: update algebra, robust reducers, trust and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trustframe.catalog.standins import r6, table, updates, updates_sql
from trustframe.functions import arrays, scalars
from trustframe.operators import metrics, trust
from trustframe.operators import updates as ops

KEYS = ["label"]
DROP_K = 5
TRIM = 0.2
COSINE = trust.MergeConfig(strategy="cosine", drop_k=DROP_K, alpha=1.0, beta=0.5, gamma=0.5)


def _coordinates(merged: DataFrame, *columns: str) -> DataFrame:
    return merged.select(*columns, F.col("pos").cast("long").alias("pos"), r6(F.col("value")).alias("value"))


def scalar_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar function over every coordinate."""
    x = F.col("x")
    y = (F.col("client_id") % 2).cast("double")
    rows = updates(spark, sf_dir, scaled=True).select("client_id", "label", F.posexplode("values").alias("pos", "x"))
    return rows.select(
        "client_id",
        F.col("pos").cast("long").alias("pos"),
        r6(scalars.sigmoid(x)).alias("sigmoid"),
        scalars.predict_at_half(x).cast("long").alias("predicted"),
        r6(scalars.clip(x, -0.1, 0.1)).alias("clipped"),
        F.floor(x * 10).cast("long").alias("floored"),
        scalars.round_half_even(F.col("client_id") / 2).cast("long").alias("half_even"),
        r6(scalars.logit_loss(x, y)).alias("loss"),
        scalars.format_int_list(
            scalars.parse_int_list(F.concat(F.col("client_id"), F.lit(", 7,, "), F.col("label"), F.lit(",")))
        ).alias("ids"),
    )


def state_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = updates(spark, sf_dir)
    base = states.groupBy(*KEYS).agg(F.min_by("values", "client_id").alias("base"))
    return _coordinates(ops.flatten(ops.state_delta(states, base, KEYS), ["label", "client_id"]), "label", "client_id")


def update_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates(spark, sf_dir, scaled=True).select(
        "label", "client_id", r6(arrays.l2_norm(F.col("values"))).alias("norm")
    )


def clip_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    clipped = ops.clip_updates(updates(spark, sf_dir, scaled=True), 2.5)
    return _coordinates(ops.flatten(clipped, ["label", "client_id"]), "label", "client_id")


def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coordinates(ops.weighted_mean(updates(spark, sf_dir), KEYS), "label")


def coord_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coordinates(ops.coordinate_median(updates(spark, sf_dir), KEYS), "label")


def trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coordinates(ops.trimmed_mean(updates(spark, sf_dir), TRIM, KEYS), "label")


def cosine_to_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.with_similarity(updates(spark, sf_dir), KEYS).select(
        "label", "client_id", r6(F.col("cosine_similarity")).alias("sim")
    )


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates with stand-in loss stability and cross-layer scores."""
    return (
        updates(spark, sf_dir)
        .withColumn("loss_stability", 1.0 / (1.0 + F.col("client_id") % 3))
        .withColumn("cross_layer", 1.0 / (1.0 + F.col("client_id") % 7))
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.score_updates(_diagnosed(spark, sf_dir), COSINE, KEYS)


def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    similar = trust.with_similarity(_diagnosed(spark, sf_dir), KEYS)
    score = trust.trust_score(F.col("cosine_similarity"), F.col("loss_stability"), F.col("cross_layer"), COSINE)
    return similar.select("label", "client_id", r6(score).alias("trust"))


def drop_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    similar = trust.with_similarity(updates(spark, sf_dir), KEYS)
    flagged = trust.with_used_flag(similar.drop("values"), DROP_K, KEYS)
    return flagged.select("label", "client_id", F.col("used").alias("kept"))


def trust_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coordinates(trust.trust_weighted_mean(_scored(spark, sf_dir), KEYS), "label")


def merge_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy on updates clipped to norm 2.5."""
    given = _diagnosed(spark, sf_dir).withColumn("values", arrays.scale(F.col("values"), F.col("weight")))
    merged = None
    for strategy in trust.STRATEGIES:
        config = trust.MergeConfig(strategy, DROP_K, 2.5, TRIM, COSINE.alpha, COSINE.beta, COSINE.gamma)
        part = trust.merge_updates(given, config, KEYS).withColumn("strategy", F.lit(strategy))
        merged = part if merged is None else merged.unionByName(part)
    return _coordinates(merged, "strategy", "label")


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.client_feedback(_scored(spark, sf_dir), KEYS)


def client_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feedback(spark, sf_dir)
    numbers = ["trust", "cosine_similarity", "loss_stability", "cross_layer"]
    return rows.select("label", "client_id", "used", *[r6(F.col(c)).alias(c) for c in numbers], "notes")


def round_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = metrics.round_diagnostics(_feedback(spark, sf_dir), KEYS)
    return summary.select("label", *[r6(F.col(c)).alias(c) for c in summary.columns if c != "label"])


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    scores = metrics.binary_metrics(marked, F.col("quality"), 1 - F.col("toxic"), ["lang"])
    ratios = [c for c in scores.columns if c not in ("lang", "tp", "fp", "tn", "fn")]
    return scores.select("lang", "tp", "fp", "tn", "fn", *[r6(F.col(c)).alias(c) for c in ratios])


QUERIES = {
    query.__name__: query
    for query in (
        scalar_pack, state_delta, update_norm, clip_update, weighted_mean, coord_median, trimmed_mean,
        cosine_to_mean, trust_score, drop_outliers, trust_weighted_mean, merge_strategies, client_feedback,
        round_diagnostics, binary_metrics,
    )
}

_UPD = updates_sql()
_SCALED = updates_sql(scaled=True)

_SIMILAR = """mean_update AS (SELECT label, pos, avg(value) AS m FROM upd GROUP BY ALL),
sims AS (
  SELECT label, client_id, any_value(weight) AS weight,
         CASE WHEN sqrt(sum(value * value)) * sqrt(sum(m * m)) <= 0 THEN 0.0
              ELSE sum(value * m) / (sqrt(sum(value * value)) * sqrt(sum(m * m))) END AS sim
  FROM upd JOIN mean_update USING (label, pos) GROUP BY label, client_id)"""

_SCORED = f"""{_SIMILAR},
scored AS (
  SELECT *, 1.0::DOUBLE / (1 + client_id % 3) AS stability, 1.0::DOUBLE / (1 + client_id % 7) AS layers,
         least(1.0, greatest(0.0, (greatest(0.0, (sim + 1) / 2) + 0.5 * (1.0::DOUBLE / (1 + client_id % 3))
           + 0.5 * (1.0::DOUBLE / (1 + client_id % 7))) / 2.0)) AS trust
  FROM sims),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim, client_id) AS rn,
         count(*) OVER (PARTITION BY label) AS n
  FROM scored),
flagged AS (SELECT *, NOT (n > {DROP_K} AND rn <= {DROP_K}) AS used FROM ranked)"""

_TRUSTED = """sums AS (
  SELECT label, pos, sum(value * weight * trust) AS a, sum(weight * trust) AS b
  FROM upd JOIN (SELECT label, client_id, trust FROM flagged WHERE used) USING (label, client_id) GROUP BY ALL)"""

_TRIMMED = f"""ordered AS (
  SELECT *, row_number() OVER (PARTITION BY label, pos ORDER BY value) AS rn,
         count(*) OVER (PARTITION BY label, pos) AS n FROM upd),
cut AS (SELECT *, CASE WHEN 2 * floor({TRIM} * n) < n THEN floor({TRIM} * n) ELSE 0 END AS k FROM ordered)"""

ORACLES = {
    "scalar_pack": f"""
WITH {_SCALED}, one AS (SELECT client_id, label, pos, value AS x, (client_id % 2)::DOUBLE AS y FROM upd)
SELECT client_id, pos::BIGINT AS pos, round(1 / (1 + exp(-x)), 6) + 0.0 AS sigmoid,
       CASE WHEN 1 / (1 + exp(-x)) >= 0.5 THEN 1 ELSE 0 END::BIGINT AS predicted,
       round(greatest(-0.1::DOUBLE, least(0.1::DOUBLE, x)), 6) + 0.0 AS clipped,
       floor(x * 10)::BIGINT AS floored,
       round_even(client_id / 2.0::DOUBLE, 0)::BIGINT AS half_even,
       round(greatest(x, 0) - x * y + ln(1 + exp(-abs(x))), 6) + 0.0 AS loss,
       concat(client_id, ',7,', label) AS ids
FROM one""",
    "state_delta": f"""
WITH {_UPD}, base AS (SELECT label, pos, arg_min(value, client_id) AS b FROM upd GROUP BY ALL)
SELECT label, client_id, pos::BIGINT AS pos, round(value - b, 6) + 0.0 AS value
FROM upd JOIN base USING (label, pos)""",
    "update_norm": f"""
WITH {_SCALED} SELECT label, client_id, round(sqrt(sum(value * value)), 6) + 0.0 AS norm FROM upd GROUP BY ALL""",
    "clip_update": f"""
WITH {_SCALED}, norms AS (SELECT client_id, sqrt(sum(value * value)) AS n FROM upd GROUP BY ALL)
SELECT label, client_id, pos::BIGINT AS pos,
       round(CASE WHEN n <= 0 OR n <= 2.5 THEN value ELSE value * (2.5::DOUBLE / n) END, 6) + 0.0 AS value
FROM upd JOIN norms USING (client_id)""",
    "weighted_mean": f"""
WITH {_UPD} SELECT label, pos::BIGINT AS pos, round(sum(value * weight) / sum(weight), 6) + 0.0 AS value
FROM upd GROUP BY ALL""",
    "coord_median": f"""
WITH {_UPD} SELECT label, pos::BIGINT AS pos, round(quantile_disc(value, 0.5), 6) + 0.0 AS value
FROM upd GROUP BY ALL""",
    "trimmed_mean": f"""
WITH {_UPD}, {_TRIMMED}
SELECT label, pos::BIGINT AS pos, round(avg(value), 6) + 0.0 AS value
FROM cut WHERE rn > k AND rn <= n - k GROUP BY ALL""",
    "cosine_to_mean": f"""
WITH {_UPD}, {_SIMILAR} SELECT label, client_id, round(sim, 6) + 0.0 AS sim FROM sims""",
    "trust_score": f"""
WITH {_UPD}, {_SCORED} SELECT label, client_id, round(trust, 6) + 0.0 AS trust FROM scored""",
    "drop_outliers": f"""
WITH {_UPD}, {_SCORED} SELECT label, client_id, used AS kept FROM flagged""",
    "trust_weighted_mean": f"""
WITH {_UPD}, {_SCORED}, {_TRUSTED}
SELECT label, pos::BIGINT AS pos, round(a / b, 6) + 0.0 AS value FROM sums""",
    "merge_strategies": f"""
WITH raw AS (WITH {_SCALED} SELECT * FROM upd),
norms AS (SELECT client_id, sqrt(sum(value * value)) AS n FROM raw GROUP BY ALL),
upd AS (SELECT label, client_id, weight, pos,
               CASE WHEN n <= 2.5 THEN value ELSE value * (2.5::DOUBLE / n) END AS value
        FROM raw JOIN norms USING (client_id)),
{_SCORED}, {_TRUSTED}, {_TRIMMED},
merged AS (
  SELECT 'fedavg' AS strategy, label, pos, sum(value * weight) / sum(weight) AS value FROM upd GROUP BY ALL
  UNION ALL SELECT 'cosine', label, pos, a / b FROM sums
  UNION ALL SELECT 'trimmed_mean', label, pos, avg(value) FROM cut WHERE rn > k AND rn <= n - k GROUP BY label, pos
  UNION ALL SELECT 'median', label, pos, quantile_disc(value, 0.5) FROM upd GROUP BY label, pos)
SELECT strategy, label, pos::BIGINT AS pos, round(value, 6) + 0.0 AS value FROM merged""",
    "client_feedback": f"""
WITH {_UPD}, {_SCORED}
SELECT label, client_id, used, round(trust, 6) + 0.0 AS trust, round(sim, 6) + 0.0 AS cosine_similarity,
       round(stability, 6) + 0.0 AS loss_stability, round(layers, 6) + 0.0 AS cross_layer,
       CASE WHEN NOT used THEN 'dropped_by_server' END AS notes
FROM flagged""",
    "round_diagnostics": f"""
WITH {_UPD}, {_SCORED}
SELECT label, round(min(sim), 6) + 0.0 AS cosine_sim_min, round(avg(sim), 6) + 0.0 AS cosine_sim_mean,
       round(min(trust), 6) + 0.0 AS trust_min, round(avg(trust), 6) + 0.0 AS trust_mean,
       round(avg(stability), 6) + 0.0 AS loss_stability_mean, round(avg(layers), 6) + 0.0 AS cross_layer_mean,
       nullif(count(*) FILTER (NOT used), 0)::DOUBLE AS dropped_clients
FROM flagged GROUP BY label""",
    "binary_metrics": """
WITH marked AS (SELECT lang, quality AS y, 1 - toxic AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
             count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn
      FROM marked GROUP BY lang)
SELECT lang, tp, fp, tn, fn,
       round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0), 6) + 0.0 AS accuracy,
       round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision,
       round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) + 0.0 AS recall,
       round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS f1,
       round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) + 0.0 AS false_positive_rate,
       round(coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0), 6) + 0.0 AS false_negative_rate
FROM c""",
}
