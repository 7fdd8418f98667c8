"""Cutting lineage, and joining with tables whose size is known only at run time."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

# A settled table up to this many rows becomes a literal of the plan; with array columns the limit is lower.
NARROW_ROWS = 200_000
ARRAY_ROWS = 500
LITERAL_BYTES = 32 * 1024 * 1024
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a local one only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not re.match(r"local(\[|$)", context.master):  # local-cluster has executors of their own
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(configured)


def any_path(spark: SparkSession, pattern: str) -> bool:
    """Whether a file or folder matches ``pattern``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder, removed when the driver's JVM ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_for_iteration(df: DataFrame) -> DataFrame:
    """Persist a table that will be read many times; the caller unpersists it. Lost blocks are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@dataclass(frozen=True)
class Settled:
    """A table that was computed once, with the outcome of its size check."""

    df: DataFrame
    small: bool

    def derive(self, df: DataFrame) -> "Settled":
        """A table worked out from this one that has no more than a few times its rows."""
        return Settled(df, self.small)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the program itself (lookups, specs) as a local table of the plan."""
    fields = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(column), type=to_arrow_type(field.dataType)) for column, field in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=fields.names), fields)


def settle(df: DataFrame, max_rows: int | None = None) -> Settled:
    """Compute a summary table (limits, means, fitted values) that later stages read several times.

    Up to ``max_rows`` it is held as a literal of the plan, which is what broadcasting it would also do; a larger
    one is written to the checkpoint folder and broadcast only when its counted size allows.
    """
    if max_rows is None:
        nested = any(isinstance(f.dataType, (T.ArrayType, T.MapType)) for f in df.schema.fields)
        max_rows = ARRAY_ROWS if nested else NARROW_ROWS
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows and head.nbytes <= LITERAL_BYTES:
        return Settled(df.sparkSession.createDataFrame(head, _nullable(df.schema)), True)
    written = cut_lineage(df)
    return Settled(written, measured_bytes(written) <= BROADCAST_LIMIT_BYTES)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _row_width(df: DataFrame):
    width = F.lit(0)
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType)):
            width = width + F.coalesce(F.size(column), F.lit(0)) * 16 + 16
        elif isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(column), F.lit(0)) + 16
        else:
            width = width + 16
    return width


def measured_bytes(df: DataFrame) -> int:
    """Size of an already materialised table, by counting."""
    return int(df.select(F.sum(_row_width(df).cast("long")).alias("bytes")).first()["bytes"] or 0)


def join_checked(large: DataFrame, small: Settled, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a settled table: broadcast when its size was found to allow it, else a sort-merge join.

    Adaptive execution splits the partitions of hot keys in the latter. Without keys every row meets every row of
    the table, so that one has to be small.
    """
    if not on:
        if not small.small:
            raise ValueError("a join without keys needs a small table")
        return large.crossJoin(F.broadcast(small.df))
    return large.join(F.broadcast(small.df) if small.small else small.df.hint("merge"), on, how)


def in_blocks(
    large: DataFrame, small: Settled, on: list[str], work: Callable[[DataFrame], DataFrame], limit: int | None = None
) -> DataFrame:
    """``work`` on the join of a table with all rows of a settled one (every pair of rows, if ``on`` is empty).

    A settled table too large for a broadcast is dealt by hash into blocks that are not; each block meets the large
    table in a pass of its own, so the large one is never shuffled and a hot key stays spread. ``work`` has to keep
    rows of the settled table apart, since the results of the blocks are put one below the other.
    """
    if small.small:
        return work(join_checked(large, small, on))
    limit = BROADCAST_LIMIT_BYTES if limit is None else limit
    blocks = max(1, -(-2 * measured_bytes(small.df) // limit))  # half full on average
    block = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in small.df.columns]), F.lit(blocks))
    parts = [work(join_checked(large, Settled(small.df.where(block == at), True), on)) for at in range(blocks)]
    return functools.reduce(DataFrame.unionByName, parts)
