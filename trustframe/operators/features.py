"""Feature preparation: impute, one-hot encode and standardise, fitted once and applied to any split.

Fitting gives a few numbers per column. They are kept as literals, so applying them is one projection inside the
scan stage, with no join and no refit. Order is impute, then encode or scale: scaling statistics count the filled
values too.

A categorical column of more levels than a projection should hold is fitted as a table of levels and their positions.
It is joined by key, and the column becomes one sparse vector with the same cells that dense columns would have.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trustframe.functions.labels import binary_label
from trustframe.operators.materialize import Settled, join_checked, settle
from trustframe.operators.order_stats import DIRECT_ROWS, exact_median, largest_group
from trustframe.operators.rank import range_row_number

# A column of up to so many levels is encoded as columns, one of more levels as a sparse vector.
MAX_LEVELS = 2000
LEVEL_SCHEMA = "col string, level string, position int"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def present_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [name for name in wanted if name in df.columns]


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
    return [name for name, kind in df.dtypes if kind in kinds or kind.startswith("decimal")]


def _number(name: str) -> Column:
    value = quoted(name).cast("double")
    return F.when(~F.isnan(value), value)


def numeric_statistics(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """``(by..., col, n, missing, median, mean, std_pop)``: mean and deviation are those after the median fill.

    One wide aggregate gives the moments; the fill is a constant, so its effect on mean and deviation is worked
    out from the counts and needs no second pass.
    """
    by = list(by)
    moments = df.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(name).alias("col"),
                F.count(_number(name)).alias("present"),
                F.count(F.lit(1)).alias("rows"),
                F.avg(_number(name)).alias("avg"),
                F.var_pop(_number(name)).alias("var"),
            ).alias(f"_{i}")
            for i, name in enumerate(columns)
        ]
    )
    moments = moments.select(*by, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))
    cells = F.array(*[F.struct(F.lit(name).alias("col"), _number(name).alias("x")) for name in columns])
    medians = exact_median(
        df.select(*by, F.inline(cells)),
        [*by, "col"],
        "x",
        group_rows=largest_group(df, by),
        direct_rows=direct_rows,
    ).drop("n")

    present, rows, avg = F.col("present"), F.col("rows"), F.col("avg")
    missing = rows - present
    shift = F.col("median") - avg
    mean = avg + shift * missing / rows
    variance = (present * F.col("var") + shift * shift * present * missing / rows) / rows
    return moments.join(medians, [*by, "col"], "left").select(
        *by,
        "col",
        rows.alias("n"),
        missing.alias("missing"),
        "median",
        mean.alias("mean"),
        F.sqrt(variance).alias("std_pop"),
    )


def level_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., col, level, n)`` of all values that are not null."""
    cells = F.array(*[F.struct(F.lit(name).alias("col"), quoted(name).cast("string").alias("level")) for name in columns])
    long = df.select(*by, F.inline(cells)).where(F.col("level").isNotNull())
    return long.groupBy(*by, "col", "level").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(levels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., col, fill)``: the most frequent level, the smallest one on ties."""
    best = F.min(F.struct((-F.col("n")).alias("order"), F.col("level").alias("level")))
    return levels.groupBy(*by, "col").agg(best.alias("_best")).select(*by, "col", F.col("_best.level").alias("fill"))


@dataclass(frozen=True)
class FittedFeatures:
    """Fitted preparation: what to fill, which levels to encode, how to scale.

    ``wide`` holds fill and number of levels of the columns that ``levels (col, level, position)`` encodes.
    """

    categorical: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    numeric: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    wide: dict[str, tuple[str, int]] = field(default_factory=dict)
    levels: Settled | None = None

    @property
    def names(self) -> list[str]:
        """Names of the prepared columns that are numbers."""
        encoded = [f"{name}_{level}" for name, (_, levels) in self.categorical.items() for level in levels]
        return encoded + list(self.numeric)

    @property
    def vector_names(self) -> list[str]:
        """Names of the prepared columns that are sparse vectors, one for each wide column."""
        return [f"{name}_levels" for name in self.wide]

    def expressions(self) -> list[Column]:
        out = []
        for name, (fill, levels) in self.categorical.items():
            filled = F.coalesce(quoted(name).cast("string"), F.lit(fill))
            out += [(filled == level).cast("double").alias(f"{name}_{level}") for level in levels]
        for name, (median, mean, std) in self.numeric.items():
            filled = F.coalesce(_number(name), F.lit(median))
            out.append(((filled - F.lit(mean)) / F.lit(std if std > 0 else 1.0)).alias(name))
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Kept columns, the prepared numbers, then the vectors; an unseen level encodes as all zeros."""
        places = [f"_place{i}" for i in range(len(self.wide))]
        filled = [F.coalesce(quoted(name).cast("string"), F.lit(fill)) for name, (fill, _) in self.wide.items()]
        out = df.select(*keep, *self.expressions(), *[f.alias(place) for f, place in zip(filled, places)])
        for place, (name, (_, size)) in zip(places, self.wide.items()):
            table = self.levels.df.where(F.col("col") == name).select(F.col("level").alias(place), F.col("position").alias("_at"))
            found = join_checked(out, self.levels.derive(table), [place], "left")
            out = found.withColumn(place, F.coalesce("_at", F.lit(size)).cast("double")).drop("_at")
        if not places:
            return out
        dense = [name for name in out.columns if name not in places]
        encoded = self._encoder(df.sparkSession, places).transform(out)
        return encoded.select(*[quoted(name) for name in dense], *self.vector_names)

    def _encoder(self, spark: SparkSession, places: list[str]):
        """Positions to sparse vectors; the position after the last level, for unseen ones, is a vector of zeros."""
        from pyspark.ml.feature import OneHotEncoder

        last = spark.createDataFrame([tuple(float(size - 1) for _, size in self.wide.values())], ", ".join(f"{p} double" for p in places))
        return OneHotEncoder(inputCols=places, outputCols=self.vector_names, handleInvalid="keep", dropLast=True).fit(last)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, name, "categorical", fill, levels, None, None, None)
            for i, (name, (fill, levels)) in enumerate(self.categorical.items())
        ] + [
            (i, name, "numeric", None, None, median, mean, std)
            for i, (name, (median, mean, std)) in enumerate(self.numeric.items())
        ] + [(i, name, "wide", fill, None, None, None, None) for i, (name, (fill, _)) in enumerate(self.wide.items())]
        return spark.createDataFrame(
            rows,
            "position int, col string, kind string, fill string, levels array<string>, "
            "median double, mean double, std_pop double",
        )

    @staticmethod
    def from_table(table: DataFrame, levels: DataFrame | None = None) -> "FittedFeatures":
        """``levels`` is the table of the wide columns' levels, if there are any."""
        rows = sorted(table.collect(), key=lambda row: row["position"])
        fills = {r["col"]: r["fill"] for r in rows if r["kind"] == "wide"}
        sizes = {r["col"]: r["count"] for r in levels.groupBy("col").count().collect()} if fills else {}
        return FittedFeatures(
            {r["col"]: (r["fill"], list(r["levels"])) for r in rows if r["kind"] == "categorical"},
            {r["col"]: (r["median"], r["mean"], r["std_pop"]) for r in rows if r["kind"] == "numeric"},
            {name: (fill, sizes[name]) for name, fill in fills.items()},
            settle(levels) if fills else None,
        )


def fit_features(
    df: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    direct_rows: int = DIRECT_ROWS,
    max_levels: int = MAX_LEVELS,
) -> FittedFeatures:
    """Fit on a split. Listed columns that are absent, or hold no value at all, are left out.

    Only the levels of columns with up to ``max_levels`` of them come to the driver.
    """
    categorical = present_columns(df, categorical)
    numeric = present_columns(df, numeric)
    encoded: dict[str, tuple[str, list[str]]] = {}
    wide: dict[str, tuple[str, int]] = {}
    table = None
    if categorical:
        levels = settle(level_counts(df, categorical)).df
        sizes = {r["col"]: r["count"] for r in levels.groupBy("col").count().collect()}
        fills = {r["col"]: r["fill"] for r in most_frequent(levels).collect()}
        narrow = [name for name in categorical if 0 < sizes.get(name, 0) <= max_levels]
        wide = {name: (fills[name], sizes[name]) for name in categorical if sizes.get(name, 0) > max_levels}
        members: dict[str, list[str]] = {name: [] for name in narrow}
        for row in levels.where(F.col("col").isin(narrow)).select("col", "level").collect():
            members[row["col"]].append(row["level"])
        encoded = {name: (fills[name], sorted(members[name])) for name in narrow}
        if wide:
            many = levels.where(F.col("col").isin(list(wide))).select("col", "level")
            numbered = range_row_number(many, ["col"], ["level"], "position")
            table = settle(numbered.select("col", "level", (F.col("position") - 1).cast("int").alias("position")))
    scaled: dict[str, tuple[float, float, float]] = {}
    if numeric:
        stats = {r["col"]: r for r in numeric_statistics(df, numeric, direct_rows=direct_rows).collect()}
        scaled = {
            name: (stats[name]["median"], stats[name]["mean"], stats[name]["std_pop"])
            for name in numeric
            if stats[name]["median"] is not None
        }
    return FittedFeatures(encoded, scaled, wide, table)


def one_hot_long(df: DataFrame, row_key: Sequence[str], columns: Sequence[str], levels: DataFrame) -> DataFrame:
    """Encoding with any number of levels: one row ``(row_key..., col, level)`` for each 1.

    Rows whose value was not seen at fit time have no entry. The join is an equi join on column and level, and the
    level table is broadcast only when its measured size allows.
    """
    known = settle(levels.select("col", "level").distinct())
    fills = settle(most_frequent(levels))
    cells = F.array(*[F.struct(F.lit(name).alias("col"), quoted(name).cast("string").alias("level")) for name in columns])
    long = join_checked(df.select(*row_key, F.inline(cells)), fills, ["col"])
    filled = long.withColumn("level", F.coalesce("level", "fill")).drop("fill")
    return join_checked(filled, known, ["col", "level"]).select(*row_key, "col", "level")


def prepare(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], label: str = "label") -> DataFrame:
    """Fit, transform and label one frame."""
    if label not in df.columns:
        raise ValueError(f"expected a '{label}' column")
    fitted = fit_features(df, categorical, numeric)
    labelled = fitted.transform(df, [binary_label(quoted(label)).alias("_label")])
    return labelled.select(*[quoted(name) for name in labelled.columns if name != "_label"], F.col("_label").alias("label"))
