"""Row numbers over huge groups, and the first k rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trustframe.operators.materialize import Settled, cut_lineage, join_checked, settle
from trustframe.operators.order_stats import kth_smallest

# Spark drops rows beyond the limit before the shuffle for row_number() <= k up to this k.
GROUP_LIMIT = 1000


def spread_row_number(
    df: DataFrame,
    keys: list[str],
    digest: str,
    tie: list[str],
    out: str = "rn",
    hex_digits: int = 4,
    leading: Column | None = None,
    needed: Settled | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by [leading,] digest, tie)`` without one task per group.

    ``digest`` is a uniform hex hash. Rows are bucketed by its first digits; the buckets are counted (a partial
    aggregate), the counts are summed up in bucket order (at most ``16 ** hex_digits`` rows per key and value of
    ``leading``), and rows are numbered inside their bucket. The rows are shuffled once: the numbering and the
    join with the bucket offsets need the same partitioning.

    ``leading`` is a small integer that sorts before the digest. ``needed`` holds ``(keys..., _needed)``, the
    largest row number wanted of each key: rows of later buckets are dropped before the shuffle.
    """
    prefix = F.conv(F.substring(F.col(digest), 1, hex_digits), 16, 10).cast("int")
    if leading is not None:
        prefix = leading.cast("int") * F.lit(16**hex_digits) + prefix
    bucketed = df.withColumn("_bucket", prefix)

    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    if needed is not None:
        offsets = join_checked(offsets, needed, keys).where(F.col("_offset") < F.col("_needed"))
        last = needed.derive(offsets.groupBy(*keys).agg(F.max("_bucket").alias("_last")))
        bucketed = join_checked(bucketed, last, keys).where(F.col("_bucket") <= F.col("_last")).drop("_last")

    inside = Window.partitionBy(*keys, "_bucket").orderBy(digest, *tie)
    numbered = bucketed.withColumn("_inner", F.row_number().over(inside))
    joined = numbered.join(offsets.hint("merge"), [*keys, "_bucket"])
    ranked = joined.withColumn(out, F.col("_inner") + F.col("_offset"))
    if needed is not None:
        ranked = ranked.where(F.col(out) <= F.col("_needed")).drop("_needed")
    return ranked.drop("_inner", "_offset", "_bucket")


def range_row_number(df: DataFrame, keys: list[str], order: list[str], out: str = "rn") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` by sorting ranges, for keys of any size.

    Rows are sorted by range and written; every range counts its rows of a key, and sums of these counts, a row for
    each range and key, tell where the range starts. Rows should differ in ``order`` for the numbers to be unique.
    """
    by = [*keys, *order]
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = cut_lineage(spread.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n"))
    placed = join_checked(rows.withColumn("_part", part), starts, [*keys, "_part"])
    return placed.withColumn(out, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_first", "_before")


def running_total(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, step: int = 4096
) -> DataFrame:
    """``sum(value) over (partition by keys order by order)`` for integers ``order`` that are unique within a key.

    Totals are taken over blocks of ``step`` consecutive integers, and the totals of blocks likewise, so no window
    holds more than ``step`` rows, even without ``keys``.
    """
    limits = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    low = limits["low"] or 0  # blocks start at the least integer, so each level has fewer of them
    rows = df.withColumn("_block", F.expr(f"(`{order}` - {low}L) div {step}L"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    if limits["low"] is None or limits["high"] - low < step:
        return rows.withColumn(out, F.sum(value).over(inside)).drop("_block")
    totals = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = running_total(totals.withColumnRenamed("_block", "_at"), keys, "_at", "_sum", "_upto", step)
    before = before.select(*keys, F.col("_at").alias("_block"), (F.col("_upto") - F.col("_sum")).alias("_before"))
    joined = rows.withColumn("_in", F.sum(value).over(inside)).join(before, [*keys, "_block"])
    return joined.withColumn(out, F.col("_in") + F.col("_before")).drop("_block", "_in", "_before")


def smallest_limit(
    df: DataFrame, keys: list[str], value: str, tie: str, k: int, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """``(keys..., _limit)``: the last ``(value, tie)`` among the ``k`` smallest rows of each group.

    Small ``k`` takes k rows per task; a larger one is found by selection, so a hot group never meets in one task.
    """
    narrow = df.select(*keys, value, tie)
    if k <= group_limit:
        last = first_k(narrow, keys, [F.col(value).asc(), F.col(tie).asc()], k)
    else:
        last = kth_smallest(narrow, keys, value, tie, k)
    return last.groupBy(*keys).agg(F.max(F.struct(value, tie)).alias("_limit"))


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rn") -> DataFrame:
    """First ``k`` rows of each group in the given total order, with their row number.

    Each task keeps only its own first k rows of a group before the shuffle, which Spark does for ``k`` up to
    ``GROUP_LIMIT``.
    """
    if k > GROUP_LIMIT:
        raise ValueError(f"first_k is for k up to {GROUP_LIMIT}, see smallest_limit")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= F.lit(int(k)))
