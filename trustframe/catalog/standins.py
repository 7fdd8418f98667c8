"""The given tables read as connection records, family pools, client updates, run logs and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CLIENTS = 10
SEED = 1337

# Event types stand for families; `purchase` and others are named after what they stand for.
FAMILY_OF_EVENT = {"view": "normal", "click": "dos", "purchase": "probe", "signup": "r2l", "error": "u2r"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    return F.round(x, 6) + F.lit(0.0)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as records of ten clients, with nulls among numbers and categories."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        (F.col("l_suppkey") % CLIENTS).cast("int").alias("client_id"),
        F.nullif("l_quantity", F.lit(1.0)).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.col("l_tax").alias("tax"),
        F.when(F.col("l_linenumber") != 1, F.col("l_linestatus")).alias("status"),
        F.concat(F.lit("line"), F.col("l_linenumber")).alias("line"),
        F.when(F.col("l_returnflag") == "N", F.lit("normal")).otherwise(F.col("l_returnflag")).alias("label"),
    )


RECORDS_SQL = f"""rec AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
         l_suppkey % {CLIENTS} AS client_id,
         nullif(l_quantity, 1.0) AS quantity, l_extendedprice AS price,
         nullif(l_discount, 0.0) AS discount, l_tax AS tax,
         CASE WHEN l_linenumber <> 1 THEN l_linestatus END AS status,
         concat('line', l_linenumber) AS line,
         CASE WHEN l_returnflag = 'N' THEN 'normal' ELSE l_returnflag END AS label
  FROM lineitem)"""

NUMBERS = ["quantity", "price", "discount", "tax"]
CATEGORIES = ["status", "line"]


def family_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rows of five families."""
    family = F.create_map(*[F.lit(part) for pair in FAMILY_OF_EVENT.items() for part in pair])
    return table(spark, sf_dir, "events").select("event_id", family[F.col("event_type")].alias("family"))


FAMILY_SQL = """fam AS (
  SELECT event_id, CASE event_type WHEN 'view' THEN 'normal' WHEN 'click' THEN 'dos' WHEN 'purchase' THEN 'probe'
                   WHEN 'signup' THEN 'r2l' WHEN 'error' THEN 'u2r' END AS family
  FROM events)"""


def updates(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    """embeddings as client updates: label is the round, vec_id the client."""
    weight = 1 + F.col("vec_id") % 5
    values = F.col("embedding").cast("array<double>")
    if scaled:
        values = F.transform(values, lambda x: x * weight.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("label"),
        F.col("vec_id").alias("client_id"),
        weight.cast("double").alias("weight"),
        values.alias("values"),
    )


def updates_sql(scaled: bool = False) -> str:
    factor = " * (1 + vec_id % 5)" if scaled else ""
    return f"""upd AS (
  SELECT label::BIGINT AS label, vec_id AS client_id, (1 + vec_id % 5)::DOUBLE AS weight,
         i - 1 AS pos, embedding[i]::DOUBLE{factor} AS value
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as round logs: user is the run, day of month the round."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run_"), F.col("user_id")).alias("run_name"),
        F.dayofmonth("ts").alias("round"),
        F.col("ts").alias("logged_at"),
        F.col("value").alias("accuracy"),
        "event_type",
        "event_id",
    )


RUN_LOG_SQL = """log AS (
  SELECT concat('run_', user_id) AS run_name, day(ts)::INTEGER AS round, ts AS logged_at, value AS accuracy,
         event_type, event_id
  FROM events)"""
