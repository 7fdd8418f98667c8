"""Helpers that the operators of this package share: tables, shared-folder copies, text batches, graph components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trustframe.operators.materialize import ensure_checkpoint_dir, measured_bytes

# A side may be broadcast up to this many counted bytes; beyond it the same join is a shuffled one.
BROADCAST_BYTES = 16 * 1024 * 1024
# Text that one Python step holds at a time, in characters.
SLICE_CHARS = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the folder of ``spark.checkpoint.dir`` and go on from the written copy.

    All executors reach that folder, so a lost one costs nothing that was written. Spark removes the copy when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast only if its counted size is below ``limit``; else a sort-merge join."""
    return F.broadcast(small) if measured_bytes(small) <= limit else small.hint("merge")


def empty_text(column: str) -> Column:
    """Null text reads as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def column_of(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or by ``struct.field`` one inside a struct that is never null."""
    name, *fields = path.split(".")
    column = batch.column(batch.schema.get_field_index(name))
    for inner in fields:
        column = column.field(inner)
    return column


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of a slice stays near ``limit`` characters (one row at least)."""
    for batch in batches:
        column = column_of(batch, text)
        sizes = [len(value) if value is not None else 0 for value in (item.as_py() for item in column)]
        start = total = 0
        for row, size in enumerate(sizes):
            if row > start and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def map_slices(df: DataFrame, function: Callable, schema: str | T.StructType, text: str = "text") -> DataFrame:
    """``mapInArrow`` over bounded slices: ``function(slice) -> dict of columns`` by the names of ``schema``.

    An Arrow column of the slice may be handed on as it is.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        for part in sliced(batches, text):
            columns = function(part)
            if columns is not None:
                made = [columns[f.name] for f in arrow]
                made = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for c, f in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays(made, names=arrow.names)

    return df.mapInArrow(run, kind)


def whole_rows(df: DataFrame, *columns: Column) -> DataFrame:
    """Each row as one struct ``row``, beside ``columns`` (of names that cannot clash with those inside)."""
    return df.select(F.struct("*").alias("row")).select("row", *columns)


def components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """``(node, component)``: the smallest node that each node of ``edges`` reaches. Isolated nodes are not listed.

    Every round takes the smallest label among neighbours, then follows the label's own label, so the number of
    rounds grows with the logarithm of a component's diameter. Each round is written to the shared folder. A node
    with very many neighbours is aggregated in parts before the shuffle.
    """
    a, b = F.col(first), F.col(second)
    pairs = edges.where(a != b).select(a.alias("_a"), b.alias("_b"))
    both = written(pairs.unionAll(pairs.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct(), "edges")
    labels = written(
        both.groupBy("_a").agg(F.min("_b").alias("_low")).select(
            F.col("_a").alias("node"), F.least("_a", "_low").alias("component")
        ),
        "labels",
    )
    while True:
        around = both.join(labels.select(F.col("node").alias("_b"), "component"), "_b")
        lowest = around.groupBy(F.col("_a").alias("node")).agg(F.min("component").alias("_near"))
        near = labels.join(lowest, "node").select(
            "node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new")
        )
        step = labels.select(F.col("node").alias("_new"), F.col("component").alias("_jump"))
        moved = written(
            near.join(step, "_new").select("node", F.least("_new", "_jump").alias("component"), "_old"), "labels"
        )
        labels = moved.select("node", "component")
        if moved.where(F.col("component") != F.col("_old")).isEmpty():
            return labels
