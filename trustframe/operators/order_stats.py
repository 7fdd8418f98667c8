"""Exact order statistics per group, for groups of any size.

``select_ranks`` returns the values that stand at given positions of the sorted group. Groups known to be small are
sorted in one aggregate. Otherwise the position is closed in on: values are counted in buckets (partial
aggregation, a bounded number of counters per group), the bucket that holds the position is kept with its exact
minimum and maximum, and the next pass looks only at the values inside it. No pass gathers a group, and none
samples or drops a value, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trustframe.operators.materialize import Settled, join_checked, settle

DIRECT_ROWS = 1_000_000
BINS = 4096
LOG_STEPS = 64.0


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest group: the check that decides how a group may be handled."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return int(counts.agg(F.max("n")).first()[0] or 0)


def median_ranks(n: Column) -> dict[str, Column]:
    """The two middle positions; equal for odd n."""
    return {"low": F.floor((n + 1) / 2).cast("long"), "high": (F.floor(n / 2) + 1).cast("long")}


def lower_median_rank(n: Column) -> dict[str, Column]:
    return {"low": F.floor((n + 1) / 2).cast("long")}


def select_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks,
    group_rows: int | None = None,
    direct_rows: int = DIRECT_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """Rows ``(keys..., n, name...)`` with the value at each named 1-based rank of every group.

    ``ranks`` maps the group size column ``n`` to ``{name: rank}``. Null and NaN values are skipped.
    ``group_rows`` is an upper bound on the group size when the caller already knows one. ``weight`` names a column
    that says how many equal values a row stands for.
    """
    names = list(ranks(F.lit(1)))
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    clean = df.select(*keys, F.col(value).cast("double").alias("_v"), times.alias("_w")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    if group_rows is None:
        group_rows = largest_group(clean, keys)
    if group_rows > direct_rows:
        return _select_narrowing(clean, keys, names, ranks, direct_rows)
    return _select_sorted(clean, keys, names, ranks) if weight is None else _select_counted(clean, keys, names, ranks)


def _select_counted(clean: DataFrame, keys: list[str], names: list[str], ranks) -> DataFrame:
    counted = clean.groupBy(*keys, "_v").agg(F.sum("_w").alias("_n"))
    whole = Window.partitionBy(*keys)
    running = counted.withColumns({"_upto": F.sum("_n").over(whole.orderBy("_v")), "n": F.sum("_n").over(whole)})
    at = lambda rank: (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_n"))
    picked = [F.max(F.when(at(rank), F.col("_v"))).alias(name) for name, rank in ranks(F.col("n")).items()]
    return running.groupBy(*keys, "n").agg(*picked)


def with_counted_median(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """``df`` with the median of ``value`` of each group, where a row stands for ``weight`` equal values.

    For groups whose rows fit one task. Several of these on one key share a shuffle.
    """
    whole = Window.partitionBy(*keys)
    known = F.col(value).isNotNull() & ~F.isnan(value)
    upto = whole.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # NaN sorts after all numbers and null before them; both weigh nothing.
    counted = df.withColumn("_w", F.when(known, F.col(weight)).otherwise(F.lit(0).cast("long")))
    counted = counted.withColumns({"_upto": F.sum("_w").over(upto), "_total": F.sum("_w").over(whole)})
    at = lambda rank: (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_w"))
    low, high = (F.max(F.when(at(rank), F.col(value))).over(whole) for rank in median_ranks(F.col("_total")).values())
    return counted.withColumn(out, (low + high) / 2).drop("_w", "_upto", "_total")


def _select_sorted(clean: DataFrame, keys: list[str], names: list[str], ranks) -> DataFrame:
    gathered = clean.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_sorted"))
    sized = gathered.where(F.size("_sorted") > 0).withColumn("n", F.size("_sorted").cast("long"))
    wanted = ranks(F.col("n"))
    return sized.select(
        *keys, "n", *[F.element_at("_sorted", wanted[name].cast("int")).alias(name) for name in names]
    )


def _select_narrowing(clean: DataFrame, keys: list[str], names: list[str], ranks, direct_rows: int) -> DataFrame:
    # First pass: buckets of equal ratio. log() is monotone, so bucket order is value order.
    magnitude = F.least(F.floor(F.log(F.abs(F.col("_v"))) * LOG_STEPS), F.lit(10**6)) + F.lit(10**9)
    bucket = F.when(F.col("_v") == 0, F.lit(0)).otherwise(F.signum("_v").cast("long") * magnitude)
    histogram = _histogram(clean.withColumn("_b", bucket), keys)
    running = Window.partitionBy(*keys).orderBy("_b")
    histogram = histogram.withColumn("_upto", F.sum("_n").over(running))
    totals = histogram.groupBy(*keys).agg(F.sum("_n").alias("n"))
    wanted = ranks(F.col("n"))
    targets = totals.select(
        *keys,
        "n",
        F.explode(F.create_map(*[part for name in names for part in (F.lit(name), wanted[name])])).alias(
            "_name", "_rank"
        ),
    )
    hit = (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))
    found = _join_keys(histogram, targets, keys).where(hit)
    state = settle(_narrowed(found, keys))

    # Later passes: equal-width bins inside the surviving interval, until it is short or holds one value.
    while state.df.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") > direct_rows)).limit(1).count():
        is_open = (F.col("_lo") < F.col("_hi")) & (F.col("_n") > direct_rows)
        closed = state.df.where(~is_open)
        opened = state.df.where(is_open)
        inside = _inside(clean, state.derive(opened), keys)
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        binned = inside.withColumn("_b", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        histogram = _histogram(binned, [*keys, "_name"])
        running = Window.partitionBy(*keys, "_name").orderBy("_b")
        histogram = histogram.withColumn("_upto", F.sum("_n").over(running))
        ranked = _join_keys(histogram, opened.select(*keys, "_name", "n", "_rank"), [*keys, "_name"])
        state = settle(_narrowed(ranked.where(hit), keys).unionByName(closed))

    done = state.df.where(F.col("_lo") == F.col("_hi")).select(*keys, "_name", "n", F.col("_lo").alias("_value"))
    short = state.df.where(F.col("_lo") < F.col("_hi"))
    counted = _inside(clean, state.derive(short), keys).groupBy(*keys, "_name", "n", "_rank", "_v").agg(
        F.sum("_w").alias("_n")
    )
    running = Window.partitionBy(*keys, "_name").orderBy("_v")
    picked = (
        counted.withColumn("_upto", F.sum("_n").over(running))
        .where(hit)
        .select(*keys, "_name", "n", F.col("_v").alias("_value"))
    )
    return (
        done.unionByName(picked)
        .groupBy(*keys, "n")
        .agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in names])
    )


def _histogram(binned: DataFrame, keys: list[str]) -> DataFrame:
    return binned.groupBy(*keys, "_b").agg(
        F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys) if keys else left.crossJoin(right)


def _narrowed(found: DataFrame, keys: list[str]) -> DataFrame:
    """State of the search: position inside the surviving bucket and its true limits."""
    return found.select(
        *keys, "_name", "n", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), "_n", "_lo", "_hi"
    )


def _inside(clean: DataFrame, state: Settled, keys: list[str]) -> DataFrame:
    joined = join_checked(clean, state.derive(state.df.drop("_n")), keys)
    return joined.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def kth_smallest(
    df: DataFrame, keys: list[str], value: str, tie: str, k: int, direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """``(keys..., value, tie)`` of the row at position ``k`` when a group is sorted by value, then by an integer tie.

    Groups with fewer rows give their last row. The value is found first, then the tie (in two halves, each exact as
    a double) among the rows that share the value.
    """
    half = 1 << 31
    parts = ["_value", "_high", "_low"]
    rows = df.select(
        *keys,
        F.col(value).cast("double").alias("_value"),
        F.shiftright(F.col(tie).cast("long"), 31).alias("_high"),
        F.col(tie).cast("long").bitwiseAND(F.lit(half - 1)).alias("_low"),
        F.lit(int(k)).cast("long").alias("_position"),
    )
    by = [*keys, "_position"]
    for part in parts:
        at = f"{part}_at"
        found = select_ranks(rows, by, part, lambda n: {at: F.least(F.col("_position"), n)}, direct_rows=direct_rows)
        found = found.withColumn("_place", F.least(F.col("_position"), F.col("n"))).drop("n")
        joined = join_checked(rows, settle(found), by).drop("_position")
        by = [name for name in by if name != "_position"] + [at, "_place"]
        below = joined.groupBy(*by).agg(F.count_if(F.col(part) < F.col(at)).alias("_below"))
        tied = join_checked(joined.where(F.col(part) == F.col(at)), settle(below), by)
        rows = tied.withColumn("_position", F.col("_place") - F.col("_below")).drop("_place", "_below")
        by = [name for name in by if name != "_place"] + ["_position"]
    found_tie = F.col("_high_at").cast("long") * half + F.col("_low_at").cast("long")
    return rows.select(*keys, F.col("_value_at").alias(value), found_tie.alias(tie)).distinct()


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median", **limits) -> DataFrame:
    """Median that averages the two middle values: ``(keys..., n, out)``."""
    ranked = select_ranks(df, keys, value, median_ranks, **limits)
    return ranked.select(*keys, "n", ((F.col("low") + F.col("high")) / 2).alias(out))


def lower_median(df: DataFrame, keys: list[str], value: str, out: str = "median", **limits) -> DataFrame:
    """Median that takes the lower of the two middle values: ``(keys..., n, out)``."""
    return select_ranks(df, keys, value, lower_median_rank, **limits).withColumnRenamed("low", out)
