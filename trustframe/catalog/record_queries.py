"""Queries on records: ingest, labels, families and feature preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trustframe.catalog.standins import (
    CATEGORIES,
    CLIENTS,
    FAMILY_OF_EVENT,
    FAMILY_SQL,
    NUMBERS,
    RECORDS_SQL,
    family_events,
    r6,
    records,
    table,
)
from trustframe.functions.labels import binary_label as binary_column, normalize_label, with_family
from trustframe.operators import features, partition
from trustframe.operators.materialize import scratch_path
from trustframe.operators.trust import cross_layer_score
from trustframe.sources import records as source

FITTED_CLIENTS = 3
_LINE = T.StructType(
    [T.StructField("row_id", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in ("quantity", "price", "discount", "tax")]
    + [T.StructField("label", T.StringType())]
)


def ingest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem written as text lines and read back field by field."""
    rows = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    text = F.concat_ws(",", key, "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.concat("l_returnflag", F.lit(". ")))
    lines = rows.select(text.alias("value"))
    return source.parse_lines(lines, source.COMMA, _LINE)


def ingest_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a folder of comma separated and of white space separated files, through the reader."""
    rows = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    fields = [key, "l_quantity", "l_extendedprice", "l_discount", F.concat("l_returnflag", F.lit(".")), F.col("l_linenumber")]
    folder = scratch_path(spark, "records")
    for sep, chosen in ((", ", "l_linenumber % 2 = 1"), ("   ", "l_linenumber % 2 = 0")):
        rows.where(chosen).select(F.concat_ws(sep, *fields)).write.mode("append").text(folder)
    read = source.read_records(spark, folder)
    return read.select(
        F.col("c0").alias("key"), *[F.col(f"c{i}").cast("double").alias(name) for i, name in ((1, "quantity"), (2, "price"), (3, "discount"))],
        "label", F.substring_index("row_id", "-", -1).cast("long").alias("copy"),
    )


def one_hot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as levels, more than are encoded as columns; rows counted by the place of their 1, -1 without one."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 1, F.concat(F.lit("part"), F.col("l_partkey"))).alias("part"), "l_suppkey"
    )
    fitted = features.fit_features(rows.where(F.col("l_suppkey") % CLIENTS < FITTED_CLIENTS), ["part"], [], max_levels=20)
    cells = fitted.transform(rows).select(F.unwrap_udt(fitted.vector_names[0]).alias("v"))
    place = F.coalesce(F.get("v.indices", 0), F.lit(-1)).cast("long")
    return cells.groupBy(place.alias("place"), F.col("v.size").cast("long").alias("levels")).agg(F.count(F.lit(1)).alias("n"))


def prepare_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on, applied to and labelled in one frame: sums of every prepared column by label."""
    out = features.prepare(records(spark, sf_dir), CATEGORIES, NUMBERS)
    names = [name for name in out.columns if name != "label"]
    sums = out.groupBy(F.col("label").cast("long").alias("y")).agg(
        *[F.sum(features.quoted(name)).alias(name) for name in names], F.count(F.lit(1)).alias("n")
    )
    long = sums.unpivot(["y", "n"], [features.quoted(name) for name in names], "col", "total")
    return long.select("y", "n", "col", (F.round("total", 3) + F.lit(0.0)).alias("total"))


def row_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids over rows that have many copies: copies of each row and their highest number."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_discount")
    numbered = source.with_row_id(rows)
    number = F.substring_index("row_id", "-", -1).cast("long")
    return numbered.groupBy("l_returnflag", "l_linestatus", "l_discount").agg(
        F.count(F.lit(1)).alias("copies"), F.countDistinct("row_id").alias("ids"), F.max(number).alias("highest")
    )


def label_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.label_profile(table(spark, sf_dir, "events"), "event_type")


def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    raw = F.concat(F.lit(" "), F.when(F.col("l_linenumber") != 1, F.col("l_returnflag")), F.lit(".."))
    return rows.select(normalize_label(raw).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def family_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families through a mapping that lacks one label, which becomes unknown."""
    members = {family: [event] for event, family in FAMILY_OF_EVENT.items() if event != "error"}
    mapped = with_family(table(spark, sf_dir, "events"), "event_type", members=members)
    return mapped.groupBy("event_type", "family").agg(F.count(F.lit(1)).alias("n"))


def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = family_events(spark, sf_dir).withColumn("client_id", F.col("event_id") % 7)
    return partition.family_counts(rows)


def binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    target = binary_column(F.col("label")).cast("long")
    return rows.groupBy(F.col("client_id").cast("long").alias("client_id"), target.alias("y")).agg(
        F.count(F.lit(1)).alias("n")
    )


def prep_fit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = features.numeric_statistics(records(spark, sf_dir), NUMBERS)
    return stats.select("col", "n", "missing", *[r6(F.col(c)).alias(c) for c in ("median", "mean", "std_pop")])


def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = features.numeric_statistics(records(spark, sf_dir), NUMBERS, by=["client_id"])
    return stats.select(
        F.col("client_id").cast("long").alias("client_id"), "col", r6(F.col("median")).alias("fill"), "missing"
    )


def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = features.level_counts(records(spark, sf_dir), CATEGORIES, by=["client_id"])
    return features.most_frequent(levels, by=["client_id"]).select(
        F.col("client_id").cast("long").alias("client_id"), "col", "fill"
    )


def _fitted(spark: SparkSession, sf_dir: str) -> features.FittedFeatures:
    train = records(spark, sf_dir).where(F.col("client_id") < FITTED_CLIENTS)
    return features.fit_features(train.where(F.col("line") != "line7"), CATEGORIES, NUMBERS)


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every client counted by encoded level; one level is absent when fitting and encodes as zeros."""
    fitted = _fitted(spark, sf_dir)
    encoded = [name for name in fitted.names if name not in NUMBERS]
    ones = fitted.transform(records(spark, sf_dir), ["row_id"]).agg(
        *[F.sum(features.quoted(name)).alias(name) for name in encoded]
    )
    return ones.unpivot([], encoded, "level", "ones").select("level", F.col("ones").cast("long").alias("ones"))


def one_hot_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same encoding as rows instead of columns, for any number of levels."""
    rows = records(spark, sf_dir)
    train = rows.where((F.col("client_id") < FITTED_CLIENTS) & (F.col("line") != "line7"))
    long = features.one_hot_long(rows, ["row_id"], CATEGORIES, features.level_counts(train, CATEGORIES))
    return long.groupBy(F.concat_ws("_", "col", "level").alias("level")).agg(F.count(F.lit(1)).alias("ones"))


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    fitted = features.fit_features(rows, [], NUMBERS)
    scaled = fitted.transform(rows, ["row_id"])
    return scaled.select("row_id", *[r6(F.col(name)).alias(name) for name in NUMBERS])


def prep_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on three clients, applied to all others."""
    fitted = _fitted(spark, sf_dir)
    other = records(spark, sf_dir).where(F.col("client_id") >= FITTED_CLIENTS)
    out = fitted.transform(other, ["row_id"])
    return out.select("row_id", *[r6(features.quoted(name)).alias(name) for name in fitted.names])


_LAYERS = {"network": ["quantity", "price", "rare_quantity"], "application": ["rare_discount", "tax"], "other": ["absent", "status"]}


def cross_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that mix dense columns with sparse counters, whose MAD is 0."""
    rows = records(spark, sf_dir).select(
        "client_id",
        "quantity",
        "price",
        F.greatest(F.col("quantity") - 45, F.lit(0.0)).alias("rare_quantity"),
        F.greatest(F.col("discount") - 0.08, F.lit(0.0)).alias("rare_discount"),
        F.when(F.col("client_id") % 2 == 0, F.col("tax")).otherwise(F.greatest(F.col("tax") - 0.06, F.lit(0.0))).alias("tax"),
        "status",
    )
    scores = cross_layer_score(rows, groups=_LAYERS)
    return scores.select(F.col("client_id").cast("long").alias("client_id"), r6(F.col("score")).alias("score"))


QUERIES = {
    query.__name__: query
    for query in (
        ingest_records, row_copies, label_profile, label_normalize, family_map, family_counts, binary_label,
        prep_fit_stats, impute_median, impute_mode, one_hot, one_hot_sparse, standardize, prep_transform, cross_layer,
        ingest_folder, one_hot_wide, prepare_labelled,
    )
}

_NUMBER_ROWS = " UNION ALL ".join(f"SELECT client_id, '{c}' AS col, {c} AS x FROM rec" for c in NUMBERS)
_CATEGORY_ROWS = " UNION ALL ".join(f"SELECT client_id, '{c}' AS col, {c} AS level FROM rec" for c in CATEGORIES)


def _fit_sql(where: str) -> str:
    """Fill, mean and deviation of every number as one row of columns."""
    parts = []
    for c in NUMBERS:
        parts.append(f"(SELECT median({c}) FROM rec WHERE {where}) AS {c}_m")
    filled = ", ".join(
        f"(SELECT avg(coalesce({c}, {c}_m)) FROM rec WHERE {where}) AS {c}_avg, "
        f"(SELECT stddev_pop(coalesce({c}, {c}_m)) FROM rec WHERE {where}) AS {c}_std"
        for c in NUMBERS
    )
    return f"fills AS (SELECT {', '.join(parts)}), fit AS (SELECT *, {filled} FROM fills)"


def _scaled_sql(c: str) -> str:
    return f"round((coalesce({c}, {c}_m) - {c}_avg) / coalesce(nullif({c}_std, 0), 1), 6) + 0.0 AS {c}"


_TRAIN = f"client_id < {FITTED_CLIENTS} AND line <> 'line7'"
_LEVELS_SQL = f"""seen AS (
  SELECT col, level, count(*) AS n FROM ({_CATEGORY_ROWS.replace("FROM rec", f"FROM rec WHERE {_TRAIN}")})
  WHERE level IS NOT NULL GROUP BY ALL),
fill AS (SELECT col, arg_min(level, (-n, level)) AS fill FROM seen GROUP BY col)"""
_ONES_SQL = f"""
WITH {RECORDS_SQL}, {_LEVELS_SQL},
ones AS (SELECT col, coalesce(level, fill) AS level, count(*) AS ones
         FROM ({_CATEGORY_ROWS}) JOIN fill USING (col) GROUP BY ALL)
SELECT concat(seen.col, '_', seen.level) AS level, coalesce(ones, 0)::BIGINT AS ones
FROM seen LEFT JOIN ones USING (col, level)"""

ORACLES = {
    "ingest_records": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, l_quantity AS quantity,
       l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS label
FROM lineitem""",
    "row_copies": """
SELECT l_returnflag, l_linestatus, l_discount, count(*) AS copies, count(*) AS ids, count(*) AS highest
FROM lineitem GROUP BY ALL""",
    "ingest_folder": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, l_quantity AS quantity,
       l_extendedprice AS price, l_discount AS discount, l_returnflag AS label,
       row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                                       l_discount, l_returnflag) AS copy
FROM lineitem""",
    "one_hot_wide": f"""
WITH r AS (SELECT CASE WHEN l_linenumber <> 1 THEN concat('part', l_partkey) END AS part, l_suppkey FROM lineitem),
seen AS (SELECT part, count(*) AS n FROM r WHERE l_suppkey % {CLIENTS} < {FITTED_CLIENTS} AND part IS NOT NULL GROUP BY part),
placed AS (SELECT part, row_number() OVER (ORDER BY part) - 1 AS place FROM seen),
fill AS (SELECT arg_min(part, (-n, part)) AS fill FROM seen)
SELECT coalesce(place, -1)::BIGINT AS place, (SELECT count(*) FROM seen) AS levels, count(*) AS n
FROM (SELECT coalesce(part, fill) AS part FROM r, fill) LEFT JOIN placed USING (part) GROUP BY ALL""",
    "prepare_labelled": f"""
WITH {RECORDS_SQL}, {_fit_sql("true")},
cat_fill AS (SELECT (SELECT status FROM rec WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1) AS status_fill),
p AS (SELECT CASE WHEN label = 'normal' THEN 0 ELSE 1 END::BIGINT AS y, {", ".join(f"(coalesce({c}, {c}_m) - {c}_avg) / coalesce(nullif({c}_std, 0), 1) AS {c}" for c in NUMBERS)},
             {", ".join(f"(coalesce(status, status_fill) = '{v}')::DOUBLE AS status_{v}" for v in "FO")},
             {", ".join(f"(line = 'line{i}')::DOUBLE AS line_line{i}" for i in range(1, 8))}
      FROM rec, fit, cat_fill),
long AS (UNPIVOT p ON COLUMNS(* EXCLUDE (y)) INTO NAME col VALUE v)
SELECT y, count(*) AS n, col, round(sum(v), 3) + 0.0 AS total FROM long GROUP BY y, col""",
    "label_profile": """
SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10""",
    "label_normalize": """
SELECT CASE WHEN l_linenumber <> 1 THEN l_returnflag ELSE 'nan' END AS label, count(*) AS n
FROM lineitem GROUP BY ALL""",
    "family_map": f"""
SELECT event_type, CASE event_type WHEN 'view' THEN 'normal' WHEN 'click' THEN 'dos' WHEN 'purchase' THEN 'probe'
       WHEN 'signup' THEN 'r2l' ELSE 'unknown' END AS family, count(*) AS n
FROM events GROUP BY ALL""",
    "family_counts": f"""
WITH {FAMILY_SQL} SELECT event_id % 7 AS client_id, family, count(*) AS n FROM fam GROUP BY ALL""",
    "binary_label": f"""
WITH {RECORDS_SQL} SELECT client_id, CASE WHEN label = 'normal' THEN 0 ELSE 1 END::BIGINT AS y, count(*) AS n
FROM rec GROUP BY ALL""",
    "prep_fit_stats": f"""
WITH {RECORDS_SQL}, long AS ({_NUMBER_ROWS}),
med AS (SELECT col, median(x) AS m FROM long GROUP BY col)
SELECT col, count(*) AS n, count(*) - count(x) AS missing, round(any_value(m), 6) + 0.0 AS median,
       round(avg(coalesce(x, m)), 6) + 0.0 AS mean, round(stddev_pop(coalesce(x, m)), 6) + 0.0 AS std_pop
FROM long JOIN med USING (col) GROUP BY col""",
    "impute_median": f"""
WITH {RECORDS_SQL}, long AS ({_NUMBER_ROWS})
SELECT client_id, col, round(median(x), 6) + 0.0 AS fill, count(*) - count(x) AS missing FROM long GROUP BY ALL""",
    "impute_mode": f"""
WITH {RECORDS_SQL}, counts AS (SELECT client_id, col, level, count(*) AS n FROM ({_CATEGORY_ROWS})
                               WHERE level IS NOT NULL GROUP BY ALL)
SELECT client_id, col, level AS fill FROM counts
QUALIFY row_number() OVER (PARTITION BY client_id, col ORDER BY n DESC, level) = 1""",
    "one_hot": _ONES_SQL,
    "one_hot_sparse": _ONES_SQL + " WHERE ones IS NOT NULL",
    "standardize": f"""
WITH {RECORDS_SQL}, {_fit_sql("true")} SELECT row_id, {", ".join(map(_scaled_sql, NUMBERS))} FROM rec, fit""",
    "prep_transform": f"""
WITH {RECORDS_SQL}, {_LEVELS_SQL}, {_fit_sql(_TRAIN)},
wide AS (SELECT (SELECT fill FROM fill WHERE col = 'status') AS status_fill,
                (SELECT fill FROM fill WHERE col = 'line') AS line_fill)
SELECT row_id, {", ".join(map(_scaled_sql, NUMBERS))},
       {", ".join(f"(coalesce(status, status_fill) = '{v}')::DOUBLE AS status_{v}" for v in "FO")},
       {", ".join(f"(coalesce(line, line_fill) = 'line{i}')::DOUBLE AS line_line{i}" for i in range(1, 7))}
FROM rec, fit, wide WHERE client_id >= {FITTED_CLIENTS}""",
    "cross_layer": f"""
WITH {RECORDS_SQL}, cells AS (
  SELECT client_id, 'network' AS layer, 'quantity' AS feature, quantity AS x FROM rec
  UNION ALL SELECT client_id, 'network', 'price', price FROM rec
  UNION ALL SELECT client_id, 'network', 'rare_quantity', greatest(quantity - 45, 0) FROM rec
  UNION ALL SELECT client_id, 'application', 'rare_discount', greatest(discount - 0.08::DOUBLE, 0) FROM rec
  UNION ALL SELECT client_id, 'application', 'tax',
    CASE WHEN client_id % 2 = 0 THEN tax ELSE greatest(tax - 0.06::DOUBLE, 0) END FROM rec),
med AS (SELECT client_id, feature, median(x) AS m FROM cells GROUP BY ALL),
dist AS (SELECT client_id, layer, feature, abs(x - m) AS d FROM cells JOIN med USING (client_id, feature)),
mad AS (SELECT client_id, feature, median(d) AS s FROM dist GROUP BY ALL),
inten AS (SELECT client_id, layer, median(coalesce(d / nullif(s, 0), 0)) AS v
          FROM dist JOIN mad USING (client_id, feature) GROUP BY ALL)
SELECT client_id, round(1 / (1 + stddev_pop(v)), 6) + 0.0 AS score FROM inten GROUP BY client_id""",
}
