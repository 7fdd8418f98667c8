"""Stratified non-IID partitioning of one record table into client tables.

Each client asks for a share of every family. Families are shuffled by a seeded hash, and a client gets a run of
consecutive positions, so dealing out the rows is an interval join between row numbers and a small table of limits.
Clients that come up short are filled from what no client was given; fill rows are dealt the same way and are never
handed out twice.

Rows are counted by block, the first digits of their hash. Sums of these counts tell where the quotas of a family end
and which blocks of leftover rows are needed, so every row knows from its hash whether it is a quota or a leftover row.
Both are ranked in one window over blocks: the records are shuffled once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trustframe.functions.hashing import keyed_md5, keyed_uniform
from trustframe.functions.scalars import clip, round_half_even
from trustframe.operators.materialize import Settled, join_checked, literal_table, settle
from trustframe.operators.rank import running_total

# Family shares of each client type, and the order in which types are given to clients.
SHARES: dict[str, dict[str, float]] = {
    "mostly_normal": {"normal": 0.80, "dos": 0.10, "probe": 0.05, "r2l": 0.03, "u2r": 0.02},
    "mostly_dos": {"dos": 0.75, "normal": 0.15, "probe": 0.05, "r2l": 0.04, "u2r": 0.01},
    "mostly_probe": {"probe": 0.70, "normal": 0.15, "dos": 0.10, "r2l": 0.04, "u2r": 0.01},
    "mixed": {"normal": 0.40, "dos": 0.30, "probe": 0.15, "r2l": 0.10, "u2r": 0.05},
    "rare_attacks": {"r2l": 0.60, "u2r": 0.20, "normal": 0.15, "probe": 0.03, "dos": 0.02},
}
FIVE_CLIENTS = ["mostly_normal", "mostly_dos", "mixed", "mostly_probe", "rare_attacks"]
CYCLE = ["mostly_normal", "mostly_dos", "mostly_probe", "mixed", "rare_attacks"]
JITTER = 0.03
SHARE_LIMITS = (0.05, 0.95)

SPEC_SCHEMA = "client_id int, name string, family string, fraction double"


def specs_table(spark: SparkSession, specs: Sequence[tuple[str, dict[str, float]]]) -> DataFrame:
    """Spec list ``[(name, {family: fraction})]`` as a long table; clients are numbered from 1."""
    rows = [
        (i, name, family, float(fraction))
        for i, (name, shares) in enumerate(specs, start=1)
        for family, fraction in shares.items()
    ]
    return literal_table(spark, rows, SPEC_SCHEMA)


def five_client_specs(spark: SparkSession) -> DataFrame:
    return specs_table(spark, [(f"client_{i}_{kind}", SHARES[kind]) for i, kind in enumerate(FIVE_CLIENTS, start=1)])


def generated_specs(clients: DataFrame, seed: int) -> DataFrame:
    """Specs for any table of ``client_id`` numbered from 1: client types in turn, the largest share jittered.

    Shares are scaled back only when the jitter takes their sum over 1.
    """
    rows = []
    for turn, kind in enumerate(CYCLE):
        shares = SHARES[kind]
        main = max(shares, key=shares.get)
        rest = sum(share for family, share in shares.items() if family != main)
        rows += [(turn, kind, family, share, family == main, shares[main], rest) for family, share in shares.items()]
    types = literal_table(
        clients.sparkSession, rows, "turn int, kind string, family string, share double, is_main boolean, main double, rest double"
    )
    turn = ((F.col("client_id") - 1) % len(CYCLE)).cast("int")
    draw = keyed_uniform(F.col("client_id"), int(seed), "jitter")
    drawn = clients.select("client_id").withColumn("turn", turn).withColumn("draw", draw)
    shifted = clip(F.col("main") + (F.col("draw") * 2 - 1) * JITTER, *SHARE_LIMITS)
    fraction = F.when(F.col("is_main"), F.col("shifted")).otherwise(F.col("share"))
    return (
        drawn.join(F.broadcast(types), "turn")
        .withColumn("shifted", shifted)
        .select(
            F.col("client_id").cast("int").alias("client_id"),
            F.concat(F.lit("client_"), F.col("client_id"), F.lit("_"), F.col("kind")).alias("name"),
            "family",
            (fraction / F.greatest(F.lit(1.0), F.col("shifted") + F.col("rest"))).alias("fraction"),
        )
    )


def make_specs(spark: SparkSession, n_clients: int, seed: int) -> DataFrame:
    if n_clients <= 0:
        raise ValueError("n_clients must be greater than 0")
    if n_clients == len(FIVE_CLIENTS):
        return five_client_specs(spark)
    return generated_specs(spark.range(1, n_clients + 1).select(F.col("id").cast("int").alias("client_id")), seed)


def quota_limits(specs: DataFrame, pools: DataFrame, client_size: int, seed: int) -> DataFrame:
    """``(client_id, family, low, high, top)``: positions ``low < rn <= high`` of the family pool a client is given.

    Sizes are rounded half to even; a pool that runs out gives what it has. ``top`` is where the next client
    starts. When rounding takes a client over ``client_size``, rows are removed at random: positions are already
    shuffled, so removing the last ones of a family is as good as any, and only the families to shrink are drawn
    (evenly spaced picks over the client's rows from one random start, so each row has the same chance).
    """
    asked = round_half_even(F.col("fraction") * F.lit(float(client_size))).cast("long")
    sized = specs.select("client_id", "family", F.greatest(asked, F.lit(0)).alias("asked"))
    running = running_total(sized, ["family"], "client_id", "asked", "upto")
    pool = F.coalesce(F.col("pool"), F.lit(0))
    given = running.join(pools, "family", "left").select(
        "client_id",
        "family",
        F.least(F.col("upto") - F.col("asked"), pool).alias("low"),
        F.least(F.col("upto"), pool).alias("top"),
    )
    own = Window.partitionBy("client_id")
    counted = given.withColumn("n", F.col("top") - F.col("low")).withColumns(
        {
            "rows": F.sum("n").over(own),
            "before": F.sum("n").over(own.orderBy("family")) - F.col("n"),
            "draw": keyed_uniform(F.col("client_id"), int(seed), "trim"),
        }
    )
    # Pick j is at (start + floor(j * rows / over)) mod rows, so ceil(at * over / rows) picks come before a place.
    counted = counted.withColumns(
        {"over": F.greatest(F.col("rows") - F.lit(int(client_size)), F.lit(0)), "start": F.floor(F.col("draw") * F.col("rows"))}
    )
    low, high = F.col("before") - F.col("start"), F.col("before") + F.col("n") - F.col("start")
    counted = counted.withColumns({"_a": low, "_b": high, "_c": low + F.col("rows"), "_d": high + F.col("rows")})
    for name in ("_a", "_b", "_c", "_d"):
        counted = counted.withColumn(name, F.least(F.greatest(F.col(name), F.lit(0)), F.col("rows")))
        counted = counted.withColumn(name, F.expr(f"({name} * over + rows - 1) div greatest(rows, 1)"))
    hit = F.col("_b") - F.col("_a") + F.col("_d") - F.col("_c")
    return counted.select("client_id", "family", "low", (F.col("top") - hit).alias("high"), "top")


def fill_limits(limits: DataFrame, client_size: int) -> DataFrame:
    """``(client_id, low, high)``: positions in the shuffled leftovers for clients below ``client_size``."""
    needs = limits.groupBy("client_id").agg((F.lit(client_size) - F.sum(F.col("high") - F.col("low"))).alias("need"))
    needs = running_total(needs.where("need > 0"), [], "client_id", "need", "upto")
    return needs.select("client_id", (F.col("upto") - F.col("need")).alias("low"), F.col("upto").alias("high"))


def deal(ranked: DataFrame, limits: Settled, keys: list[str], rank: str = "rn") -> DataFrame:
    """Give each row the client whose interval holds its position.

    Positions are cut into steps of the mean interval width, and intervals are listed under each step they touch
    (at most two entries per interval on average). The join is then an equi join on the step, so the work per row
    does not grow with the number of clients.
    """
    filled = limits.df.where("high > low")
    steps = filled.groupBy(*keys).agg(
        F.max("high").alias("_top"), F.greatest(F.lit(1), F.ceil(F.max("high") / F.count(F.lit(1)))).alias("_step")
    )
    spans = filled.join(steps.drop("_top"), keys) if keys else filled.crossJoin(steps.drop("_top"))
    touched = F.sequence(F.floor(F.col("low") / F.col("_step")), F.floor((F.col("high") - 1) / F.col("_step")))
    spans = spans.select("client_id", *keys, "low", "high", F.explode(touched).alias("_at"))
    placed = join_checked(ranked, limits.derive(steps), keys).where(F.col(rank) <= F.col("_top"))
    placed = placed.withColumn("_at", F.floor((F.col(rank) - 1) / F.col("_step")))
    matched = join_checked(placed, limits.derive(spans), [*keys, "_at"])
    return matched.where((F.col(rank) > F.col("low")) & (F.col(rank) <= F.col("high"))).drop(
        "_top", "_step", "_at", "low", "high"
    )


def _bucket(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def _block_offsets(rows: DataFrame, keys: Sequence[str]) -> Settled:
    """``(keys..., _bucket, _size, _offset)``: rows of each block and of the blocks of lower buckets before it.

    Buckets are the first digits of a hash, so a key has at most as many blocks as there are buckets.
    """
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return settle(sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0).cast("long"))))


def _cuts(rows: DataFrame, blocks: Settled, limits: Settled, row_id: str) -> Settled:
    """``(family, _cut, _last)``: the block and the row at which the quotas of a family end.

    All rows of lower blocks belong to quotas, all of higher ones are left over, so only rows of this block are
    ranked to find its last quota row. Families without quotas, and those used up, need no search.
    """
    tops = limits.derive(limits.df.groupBy("family").agg(F.max("top").alias("_top")).where("_top > 0"))
    ends = join_checked(blocks.df, tops, ["family"])
    ends = ends.where((F.col("_offset") < F.col("_top")) & (F.col("_top") <= F.col("_offset") + F.col("_size")))
    ends = settle(ends.select("family", "_bucket", (F.col("_top") - F.col("_offset")).alias("_at")))
    inside = join_checked(rows.select("family", row_id, "_digest", "_bucket"), ends, ["family", "_bucket"])
    order = Window.partitionBy("family").orderBy("_digest", row_id)
    last = inside.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == F.col("_at"))
    return settle(last.select("family", F.col("_bucket").alias("_cut"), F.struct("_digest", row_id).alias("_last")))


def split_non_iid(
    df: DataFrame,
    specs: DataFrame,
    client_size: int | None = None,
    seed: int = 1337,
    row_id: str = "row_id",
    prefer: Sequence[str] = (),
    fill: bool = True,
) -> DataFrame:
    """Rows of ``df`` with a ``family`` column dealt to clients: adds ``client_id`` and ``shuffle_key``.

    ``shuffle_key`` is a hash by which a consumer that needs a shuffled order can sort. ``prefer`` names families
    that are used up first when clients are filled; otherwise every leftover row has the same chance.
    """
    for required in ("family", row_id):
        if required not in df.columns:
            raise ValueError(f"expected a '{required}' column")
    digest = keyed_md5(F.col(row_id), int(seed))
    rows = df.withColumn("_digest", digest).withColumn("_bucket", _bucket(F.col("_digest")))
    blocks = _block_offsets(rows, ["family"])
    pools = blocks.df.groupBy("family").agg(F.sum("_size").alias("pool"))
    if client_size is None:
        total = pools.agg(F.sum("pool")).first()[0] or 0
        client_size = total // max(1, specs.select("client_id").distinct().count())
    if client_size <= 0:
        raise ValueError("client_size must be greater than 0")

    limits = settle(quota_limits(specs, pools, client_size, seed))
    short = settle(fill_limits(limits.df, client_size))
    slots = limits.df.select(F.col("family").alias("_pool"), "client_id", "low", "high")
    offsets = blocks.df.select(F.col("family").alias("_pool"), "_bucket", "_offset")
    # Rows of lower blocks and, in the block of the cut, up to its last row are those of the quotas.
    marked = join_checked(rows, _cuts(rows, blocks, limits, row_id), ["family"], "left")
    at = F.struct("_digest", row_id)
    quota = (F.col("_bucket") < F.col("_cut")) | ((F.col("_bucket") == F.col("_cut")) & (at <= F.col("_last")))
    marked = marked.withColumn("_quota", F.coalesce(quota, F.lit(False))).drop("_cut", "_last")
    if fill and not short.df.isEmpty():
        leading = F.when(F.col("family").isin(*prefer), F.lit(0)).otherwise(F.lit(1)) if prefer else F.lit(0)
        unused = keyed_md5(F.col(row_id), int(seed), "fill")
        order = F.when(F.col("_quota"), F.col("_digest")).otherwise(unused)
        marked = marked.withColumn("_digest", order).withColumn(
            "_bucket", F.when(F.col("_quota"), F.col("_bucket")).otherwise(leading * 16**4 + _bucket(F.col("_digest")))
        )
        marked = marked.withColumn("_pool", F.when(F.col("_quota"), F.col("family")))
        wanted = short.df.agg(F.max("high")).first()[0]
        left = _block_offsets(marked.where("NOT _quota").select("_pool", "_bucket"), ["_pool"])
        left = left.derive(left.df.where(F.col("_offset") < wanted).select("_pool", "_bucket", "_offset"))
        offsets = offsets.unionByName(left.df)
        slots = slots.unionByName(short.df.select(F.lit(None).cast("string").alias("_pool"), "client_id", "low", "high"))
    else:
        marked = marked.where("_quota").withColumn("_pool", F.col("family"))

    # One ranking for both: a row is numbered within its block, and blocks that nobody needs are gone before that.
    named = lambda df: df.withColumn("_pool", F.coalesce(F.concat(F.lit("="), "_pool"), F.lit("")))
    placed = join_checked(named(marked), blocks.derive(named(offsets)), ["_pool", "_bucket"])
    inside = Window.partitionBy("_pool", "_bucket").orderBy("_digest", row_id)
    ranked = placed.withColumn("rn", F.row_number().over(inside) + F.col("_offset")).drop("_offset", "_bucket", "_digest", "_quota")
    dealt = deal(ranked, limits.derive(named(slots)), ["_pool"]).select(*df.columns, "client_id")
    return dealt.withColumn("shuffle_key", keyed_md5(F.col(row_id), int(seed), "shuffle"))


def family_counts(df: DataFrame, keys: Sequence[str] = ("client_id",)) -> DataFrame:
    return df.groupBy(*keys, "family").agg(F.count(F.lit(1)).alias("n"))


def manifest_lines(manifest: DataFrame, parameters: dict) -> DataFrame:
    """``(section, place, line)``: in this order the lines are one JSON object of the whole split.

    It has the parameters, a list ``specs`` of names and shares, and a map ``clients`` of rows and family counts.
    Each client is a line of its own, made where its row is, so no task holds the object.
    """
    spark = manifest.sparkSession
    name = F.to_json(F.struct("name"))
    quoted = F.expr("substr(_name, 9, length(_name) - 9)")  # the JSON text of the name alone
    spec = F.to_json(F.struct("name", "proportions"))
    counts = F.to_json(F.struct("client_id", "rows", F.coalesce("family_counts", F.create_map().cast("map<string, bigint>")).alias("family_counts")))
    rows = manifest.withColumn("_name", name).select("client_id", spec.alias("spec"), F.concat(quoted, F.lit(": "), counts).alias("client"))
    limits = rows.agg(F.max("client_id")).first()[0]
    ending = F.when(F.col("client_id") == F.lit(limits), F.lit("")).otherwise(F.lit(","))
    place = F.col("client_id").cast("long").alias("place")
    line = lambda section, text: rows.select(F.lit(section).alias("section"), place, F.concat(F.col(text), ending).alias("line"))
    head = "".join(f"{json.dumps(key)}: {json.dumps(value)},\n" for key, value in parameters.items())
    fixed = literal_table(
        spark, [(0, 0, "{\n" + head + '"specs": ['), (2, 0, '],\n"clients": {'), (4, 0, "}\n}")], "section int, place long, line string"
    )
    return fixed.unionByName(line(1, "spec")).unionByName(line(3, "client"))


def write_manifest(manifest: DataFrame, path: str, source: str, output: str) -> None:
    """One JSON object for the whole split, as one text file in the folder ``path``, streamed in order by one task."""
    shared = manifest.agg(F.count(F.lit(1)).alias("n_clients"), F.max("client_size").alias("client_size"), F.max("seed").alias("seed"))
    parameters = {**shared.first().asDict(), "source": source, "output_dir": output}
    lines = manifest_lines(manifest, parameters).repartition(1).sortWithinPartitions("section", "place")
    lines.select("line").write.mode("errorifexists").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A written manifest, one row per client, as ``split_manifest`` gives it, with ``source`` and ``output_dir``."""
    client = "struct<client_id: int, rows: bigint, family_counts: map<string, bigint>>"
    schema = (
        "n_clients bigint, client_size int, seed int, source string, output_dir string, "
        f"specs array<struct<name: string, proportions: map<string, double>>>, clients map<string, {client}>"
    )
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    shared = ["n_clients", "client_size", "seed", "source", "output_dir"]
    named = whole.select(*shared, F.col("specs"), F.explode("clients").alias("name", "client"))
    found = F.filter("specs", lambda spec: spec["name"] == F.col("name"))
    return named.select("client.client_id", "name", *shared, F.get(found, 0)["proportions"].alias("proportions"), "client.rows", "client.family_counts")


def split_manifest(dealt: DataFrame, specs: DataFrame, client_size: int, seed: int) -> DataFrame:
    """One row per client: parameters, spec shares, rows and family counts; families are few, so maps stay short."""
    counts = family_counts(dealt).groupBy("client_id").agg(
        F.sum("n").alias("rows"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "n")))).alias("family_counts"),
    )
    shares = specs.groupBy("client_id", "name").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "fraction")))).alias("proportions")
    )
    return shares.join(counts, "client_id", "left").select(
        "client_id",
        "name",
        F.lit(int(client_size)).alias("client_size"),
        F.lit(int(seed)).alias("seed"),
        "proportions",
        F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
        "family_counts",
    )
