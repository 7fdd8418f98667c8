"""Queries on partitioning records into clients and on poisoning them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trustframe.catalog.standins import FAMILY_SQL, RECORDS_SQL, SEED, family_events, r6, records, table
from trustframe.functions.labels import binary_label
from trustframe.operators import noise, partition
from trustframe.operators.materialize import cut_lineage, scratch_path
from trustframe.operators.rank import first_k
from trustframe.sources import records as source

EVEN_SHARE = 0.2
EVEN_CLIENTS = 3
ATTACKERS = (2, 5)
FLIP_RATE = 0.3
ROUNDS = 3
PICKED = 5
PREFERRED = ("u2r", "r2l")
SHUFFLED = 20


def split_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spec per supplier."""
    clients = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("client_id"))
    specs = partition.generated_specs(clients, SEED)
    return specs.select(F.col("client_id").cast("long").alias("client_id"), "name", "family", r6(F.col("fraction")).alias("fraction"))


def _share_of_rows(rows: DataFrame, parts: int) -> int:
    return rows.count() // parts


def _filled(spark: SparkSession, sf_dir: str, fill: bool = True, prefer=()) -> DataFrame:
    rows = family_events(spark, sf_dir)
    specs = partition.five_client_specs(spark)
    return partition.split_non_iid(
        rows, specs, _share_of_rows(rows, 6), SEED, row_id="event_id", fill=fill, prefer=prefer
    )


def _assigned(dealt: DataFrame) -> DataFrame:
    return dealt.select(F.col("client_id").cast("long").alias("client_id"), "event_id")


def quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(_filled(spark, sf_dir, fill=False))


def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(_filled(spark, sf_dir))


def quota_fill_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare families are used up first when clients are filled."""
    return _assigned(_filled(spark, sf_dir, prefer=PREFERRED))


def quota_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five equal shares whose rounding goes over the client size."""
    rows = family_events(spark, sf_dir)
    shares = {family: EVEN_SHARE for family in ("normal", "dos", "probe", "r2l", "u2r")}
    specs = partition.specs_table(spark, [(f"even_{i}", shares) for i in range(EVEN_CLIENTS)])
    size = 5 * _share_of_rows(rows, 25) + 3
    return _assigned(partition.split_non_iid(rows, specs, size, SEED, row_id="event_id"))


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = family_events(spark, sf_dir)
    specs = partition.five_client_specs(spark)
    size = _share_of_rows(rows, 6)
    dealt = partition.split_non_iid(rows, specs, size, SEED, row_id="event_id")
    manifest = partition.split_manifest(dealt, specs, size, SEED)
    return manifest.select(
        F.col("client_id").cast("long").alias("client_id"), "name", "rows", F.explode("family_counts").alias("family", "n")
    )


def client_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients written as CSV with one manifest for the split, both read back: parameters, shares and rows by family."""
    rows = family_events(spark, sf_dir)
    specs = partition.five_client_specs(spark)
    size = _share_of_rows(rows, 6)
    dealt = cut_lineage(partition.split_non_iid(rows, specs, size, SEED, row_id="event_id"))
    folder = scratch_path(spark, "shards")
    source.write_client_csv(dealt, f"{folder}/clients", drop_family=False)
    partition.write_manifest(partition.split_manifest(dealt, specs, size, SEED), f"{folder}/manifest", "events", "clients")
    kept = source.read_client_csv(spark, f"{folder}/clients")
    found = kept.groupBy("client_id", "family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id").cast("long")).alias("ids"))
    told = partition.read_manifest(spark, f"{folder}/manifest")
    shares = told.select(*[c for c in told.columns if c not in ("proportions", "family_counts")], F.explode("proportions").alias("family", "share"), "family_counts")
    joined = shares.join(found, ["client_id", "family"], "left")
    whole = {c: F.col(c).cast("long") for c in ("client_id", "client_size", "seed")}
    return joined.withColumns(whole).select(
        "client_id", "name", "n_clients", "client_size", "seed", "source", "output_dir", "rows", "family", "share",
        F.coalesce(F.try_element_at("family_counts", "family"), F.lit(0).cast("long")).alias("told"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"), "ids",
    )


def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each client in its shuffled order."""
    dealt = _filled(spark, sf_dir)
    first = first_k(dealt, ["client_id"], [F.col("shuffle_key").asc(), F.col("event_id").asc()], SHUFFLED, "place")
    return first.select(F.col("client_id").cast("long").alias("client_id"), F.col("place").cast("long").alias("place"), "event_id")


def label_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("row_id", "client_id", binary_label(F.col("label")).alias("y"))
    each = rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS))))
    bad = F.col("client_id").isin(*ATTACKERS)
    poisoned = noise.flip_labels(F.col("y"), bad, FLIP_RATE, F.col("row_id"), F.col("client_id"), F.col("round"), SEED)
    marked = each.withColumn("flipped", (poisoned != F.col("y")).cast("long"))
    return marked.groupBy(
        F.col("round").cast("long").alias("round"), F.col("client_id").cast("long").alias("client_id"), "flipped"
    ).agg(F.count(F.lit(1)).alias("n"))


def pick_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.pick_clients(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("client_id")), PICKED, SEED)


QUERIES = {
    query.__name__: query
    for query in (
        split_specs, quota_split, quota_fill, quota_fill_preferred, quota_trim, split_manifest, label_flip, pick_clients,
        client_shards, shuffle_order,
    )
}


def _spec_values(kinds: list[str]) -> str:
    return ", ".join(
        f"({i}, '{family}', {share}::DOUBLE)"
        for i, kind in enumerate(kinds, start=1)
        for family, share in partition.SHARES[kind].items()
    )


def _quota_sql(values: str, size: str) -> str:
    return f"""{FAMILY_SQL}, size AS (SELECT {size} AS size FROM fam),
spec(client_id, family, fraction) AS (VALUES {values}),
pool AS (SELECT family, count(*) AS pool FROM fam GROUP BY family),
asked AS (SELECT client_id, family, round_even(fraction * size, 0)::BIGINT AS k FROM spec, size),
running AS (SELECT *, sum(k) OVER (PARTITION BY family ORDER BY client_id) AS upto FROM asked),
span AS (SELECT client_id, family, least(upto - k, pool) AS low, least(upto, pool) AS high FROM running JOIN pool USING (family)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY md5(concat('{SEED}:', event_id)), event_id) AS rn FROM fam),
counted AS (
  SELECT *, high - low AS n, sum(high - low) OVER (PARTITION BY client_id) AS total,
         sum(high - low) OVER (PARTITION BY client_id ORDER BY family) - (high - low) AS before FROM span),
picks AS (
  SELECT client_id, (floor(u * total)::BIGINT + (j * total) // (total - size)) % total AS spot
  FROM (SELECT DISTINCT client_id, total, size, unnest(range(0, total::BIGINT - size)) AS j,
               ('0x' || substr(md5(concat('{SEED}:trim:', client_id)), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u
        FROM counted, size WHERE total > size)),
trimmed AS (
  SELECT client_id, family, low, high - (SELECT count(*) FROM picks p WHERE p.client_id = c.client_id
                                         AND spot >= before AND spot < before + n) AS kept
  FROM counted c),
dealt AS (SELECT client_id, event_id, family FROM ranked JOIN span USING (family) WHERE rn > low AND rn <= high),
quota AS (SELECT client_id, event_id, family FROM ranked JOIN trimmed USING (family) WHERE rn > low AND rn <= kept)"""


_FIVE = _quota_sql(_spec_values(partition.FIVE_CLIENTS), "count(*) // 6")


def _fill_sql(order: str = "") -> str:
    return f"""need AS (
  SELECT client_id, size - sum(kept - low) AS need FROM trimmed, size GROUP BY client_id, size HAVING size > sum(kept - low)),
slot AS (SELECT client_id, sum(need) OVER (ORDER BY client_id) - need AS low, sum(need) OVER (ORDER BY client_id) AS high FROM need),
unused AS (
  SELECT event_id, family, row_number() OVER (ORDER BY {order}md5(concat('{SEED}:fill:', event_id)), event_id) AS rn
  FROM fam WHERE event_id NOT IN (SELECT event_id FROM dealt)),
filled AS (
  SELECT * FROM quota
  UNION ALL SELECT client_id, event_id, family FROM unused JOIN slot ON rn > low AND rn <= high)"""


_EVEN = ", ".join(
    f"({i}, '{family}', {EVEN_SHARE}::DOUBLE)"
    for i in range(1, EVEN_CLIENTS + 1)
    for family in ("normal", "dos", "probe", "r2l", "u2r")
)
_TYPE_ROWS = ", ".join(
    f"({turn}, '{kind}', '{family}', {share}::DOUBLE, {share == max(shares.values())}, "
    f"{max(shares.values())}::DOUBLE, {sum(s for s in shares.values() if s != max(shares.values()))}::DOUBLE)"
    for turn, kind in enumerate(partition.CYCLE)
    for shares in [partition.SHARES[kind]]
    for family, share in shares.items()
)
_NAMES = ", ".join(f"({i}, 'client_{i}_{kind}')" for i, kind in enumerate(partition.FIVE_CLIENTS, start=1))

ORACLES = {
    "split_specs": f"""
WITH kinds(turn, kind, family, share, is_main, main, rest) AS (VALUES {_TYPE_ROWS}),
drawn AS (SELECT s_suppkey + 1 AS client_id, s_suppkey % 5 AS turn,
                 ('0x' || substr(md5(concat('{SEED}:jitter:', s_suppkey + 1)), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u
          FROM supplier),
moved AS (SELECT *, greatest(0.05::DOUBLE, least(0.95::DOUBLE, main + (u * 2 - 1) * 0.03::DOUBLE)) AS moved
          FROM drawn JOIN kinds USING (turn))
SELECT client_id, concat('client_', client_id, '_', kind) AS name, family,
       round((CASE WHEN is_main THEN moved ELSE share END) / greatest(1.0::DOUBLE, moved + rest), 6) + 0.0 AS fraction
FROM moved""",
    "quota_split": f"WITH {_FIVE} SELECT client_id::BIGINT AS client_id, event_id FROM quota",
    "quota_fill": f"WITH {_FIVE}, {_fill_sql()} SELECT client_id::BIGINT AS client_id, event_id FROM filled",
    "quota_fill_preferred": f"""
WITH {_FIVE}, {_fill_sql("family NOT IN ('u2r', 'r2l'), ")} SELECT client_id::BIGINT AS client_id, event_id FROM filled""",
    "quota_trim": f"""
WITH {_quota_sql(_EVEN, "5 * (count(*) // 25) + 3")}
SELECT client_id::BIGINT AS client_id, event_id FROM quota""",
    "split_manifest": f"""
WITH {_FIVE}, {_fill_sql()}, names(client_id, name) AS (VALUES {_NAMES}),
c AS (SELECT client_id, family, count(*) AS n FROM filled GROUP BY ALL)
SELECT client_id::BIGINT AS client_id, name, (sum(n) OVER (PARTITION BY client_id))::BIGINT AS rows, family, n
FROM c JOIN names USING (client_id)""",
    "client_shards": f"""
WITH {_FIVE}, {_fill_sql()}, names(client_id, name) AS (VALUES {_NAMES}),
c AS (SELECT client_id, family, count(*) AS n, sum(event_id)::BIGINT AS ids FROM filled GROUP BY ALL),
totals AS (SELECT client_id, count(*) AS rows FROM filled GROUP BY client_id)
SELECT spec.client_id::BIGINT AS client_id, name, 5::BIGINT AS n_clients, size AS client_size, {SEED}::BIGINT AS seed,
       'events' AS source, 'clients' AS output_dir, rows, spec.family, fraction AS share,
       coalesce(n, 0)::BIGINT AS told, coalesce(n, 0)::BIGINT AS n, ids
FROM spec JOIN names USING (client_id) JOIN totals USING (client_id) CROSS JOIN size
LEFT JOIN c ON c.client_id = spec.client_id AND c.family = spec.family""",
    "shuffle_order": f"""
WITH {_FIVE}, {_fill_sql()},
r AS (SELECT client_id, event_id, row_number() OVER (PARTITION BY client_id ORDER BY md5(concat('{SEED}:shuffle:', event_id)), event_id) AS place FROM filled)
SELECT client_id::BIGINT AS client_id, place, event_id FROM r WHERE place <= {SHUFFLED}""",
    "label_flip": f"""
WITH {RECORDS_SQL}, each AS (SELECT *, unnest(range(1, {ROUNDS + 1})) AS round FROM rec),
marked AS (
  SELECT round, client_id,
         CASE WHEN client_id IN {ATTACKERS} AND
           ('0x' || substr(md5(concat_ws(':', '{SEED}', round, client_id, row_id)), 1, 8))::UBIGINT
             / 4294967296.0::DOUBLE < {FLIP_RATE} THEN 1 ELSE 0 END AS flipped
  FROM each)
SELECT round, client_id, flipped::BIGINT AS flipped, count(*) AS n FROM marked GROUP BY ALL""",
    "pick_clients": f"""
SELECT client_id FROM (SELECT DISTINCT l_suppkey AS client_id FROM lineitem)
ORDER BY md5(concat('{SEED}:', client_id)), client_id LIMIT {PICKED}""",
}
