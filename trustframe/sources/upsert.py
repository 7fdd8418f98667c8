"""Keyed upserts into partitioned Parquet tables: the row of the highest sequence number of each key stays on disk.

Only the partitions that the new rows touch are rewritten. Their rows and the new ones are reduced to one row per key,
written to the checkpoint folder, and put in place by a dynamic partition overwrite, which moves finished files in one
commit. Writing the same rows again, as a retried job does, changes nothing; a late row with a lower sequence number
does not replace a newer one. One writer at a time may change a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trustframe.operators.materialize import any_path, cut_lineage, join_checked, settle


def highest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the one with the highest values of ``order``. Rows are reduced before the shuffle."""
    rest = [name for name in rows.columns if name not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(pick.alias("_last")).select(*keys, "_last.*").select(*rows.columns)


def existing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table at ``path`` in the columns of ``schema``, or None where nothing was written yet."""
    return spark.read.schema(schema).parquet(path).select(*schema.names) if any_path(spark, path) else None


def replace_partitions(rows: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Write ``rows`` in place of all that their partitions hold; other partitions stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def upsert(rows: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str], order: Sequence[str]) -> None:
    """Put ``rows`` into the table at ``path``. ``partitions`` are some of ``keys``, ``order`` starts with the sequence."""
    if not set(partitions) <= set(keys):
        raise ValueError("partitions have to be some of the keys")
    new = cut_lineage(rows)
    before = existing(rows.sparkSession, path, rows.schema)
    if before is not None:
        touched = settle(new.select(*partitions).distinct())
        new = new.unionByName(join_checked(before, touched, list(partitions), "left_semi"))
    replace_partitions(cut_lineage(highest(new, keys, order)), path, partitions)
