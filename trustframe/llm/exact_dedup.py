"""Exact duplicates of documents by deterministic block naming.

Every normalised text is cut into blocks of a fixed number of bytes. Sorting all blocks gives equal blocks one integer
name. Then adjacent names of a document are paired, equal pairs get one name by sorting again, and so on until each
document has a single name. Two documents share ``(level, name)`` exactly when all their bytes are equal: names are
given by comparing contents, so there is nothing that could collide (a lone last name pairs with ``-1``, which names
nothing, and the level tells trees of different heights apart).

Scale: each slice of text (2 million characters) names its distinct blocks locally, so block contents are shuffled
once, a block that very many documents hold comes once a slice, and documents travel as small integers. Sorted blocks
stream through their task. Pairs are made distinct before the shuffle; a hot pair is a few bytes a row in a join whose
skewed partitions Spark splits. Rounds grow with the logarithm of the longest text. Groups are aggregated in parts, so
a group of any size takes one row, and every step is written to the shared folder.

Nulls and edge cases: a null text counts as empty, and empty texts are equal. A null ``doc_id`` is smaller than every
number. Repeated rows (same id, equal text) form one group with each other; one of them is kept. Very long texts are
cut like others, one text at a time. An empty table gives an empty result. Columns beside id and text are not read by
``exact_groups``; ``drop_copies`` hands them on whatever their names are.
"""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trustframe.llm.common import empty_text, read_table, sized, sliced, whole_rows, written

BLOCK_BYTES = 512
# Names and ids of a task start at its number times this.
TASK_STEP = 1 << 40
NOTHING = -1

_CUT = "route long, block binary, slice long, local int, uid long, doc_id long, digest binary, locals array<int>"
_NAMED = "slice long, local int, name long, uid long, doc_id long, digest binary, locals array<int>"


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def _cut(block_bytes: int):
    """Distinct blocks of each slice, and each document as the numbers of its blocks within the slice."""
    kind = _arrow(_CUT)

    def run(batches):
        base = TaskContext.get().partitionId() * TASK_STEP
        slices = rows = 0
        for part in sliced(batches):
            numbers: dict[bytes, int] = {}
            digests, documents = [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                data = (text or b"").lower()  # of bytes: only A-Z change
                blocks = [data[at : at + block_bytes] for at in range(0, len(data), block_bytes)] or [b""]
                documents.append([numbers.setdefault(block, len(numbers)) for block in blocks])
                digests.append(hashlib.sha256(data).digest())
            n, m = len(numbers), len(documents)
            slice_id = base + slices
            columns = {
                "route": [None] * n + [slice_id] * m,
                "block": [*numbers, *[None] * m],
                "slice": [slice_id] * (n + m),
                "local": [*range(n), *[None] * m],
                "uid": [None] * n + list(range(base + rows, base + rows + m)),
                "doc_id": [None] * n + part.column("doc_id").to_pylist(),
                "digest": [None] * n + digests,
                "locals": [None] * n + documents,
            }
            slices, rows = slices + 1, rows + m
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in kind], schema=kind)

    return run


def _name_sorted():
    """Names of sorted blocks: a row whose block differs from the one before takes the next integer of its task."""
    kind = _arrow(_NAMED)

    def run(batches):
        name, last = TaskContext.get().partitionId() * TASK_STEP, None
        for batch in batches:
            block = batch.column("block")
            if len(block) == 0:
                continue
            before = pa.concat_arrays([pa.array([last], block.type), block.slice(0, len(block) - 1)])
            is_block = block.is_valid()
            new = pc.and_(pc.fill_null(pc.not_equal(block, before), True), is_block)
            names = pc.add(pc.cumulative_sum(new.cast(pa.int64())), pa.scalar(name, pa.int64()))
            name, last = names[-1].as_py(), block[-1].as_py()
            names = pc.if_else(is_block, names, pa.scalar(None, pa.int64()))
            columns = [names if f.name == "name" else batch.column(f.name) for f in kind]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return run


def _pair_names(pairs: DataFrame) -> DataFrame:
    """``(left, right, name)``: one integer for each distinct pair."""
    distinct = pairs.select("left", "right").distinct().sortWithinPartitions("left", "right")
    return written(distinct.withColumn("name", F.monotonically_increasing_id()), "pair-names")


def _next_level(level: DataFrame) -> DataFrame:
    """Documents of several names, with adjacent names replaced by the name of the pair."""
    half = F.shiftright("pos", 1)
    even = F.col("pos") % 2 == 0
    pairs = written(
        level.where("n > 1").groupBy("uid", half.alias("pos")).agg(
            F.ceil(F.first("n") / 2).alias("n"),
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NOTHING)).alias("right"),
        ),
        "pairs",
    )
    named = pairs.join(sized(_pair_names(pairs)), ["left", "right"])
    return written(named.select("uid", "pos", "n", "name"), "names")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(uid, doc_id, digest, level, name)`` of each row: texts are equal when level and name are.

    ``uid`` numbers the rows, ``digest`` is the SHA-256 of the normalised text (it takes no part in the naming).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = rows.mapInArrow(_cut(block_bytes), _CUT)
    routed = cut.repartition(F.coalesce("route", F.xxhash64("block"))).sortWithinPartitions("block")
    named = written(routed.mapInArrow(_name_sorted(), _NAMED), "blocks")
    documents = named.where("uid IS NOT NULL")
    refs = documents.select("uid", "slice", F.size("locals").cast("long").alias("n"), F.posexplode("locals").alias("pos", "local"))
    names = named.where("uid IS NULL").select("slice", "local", "name")
    level = written(
        refs.join(names.hint("merge"), ["slice", "local"]).select("uid", F.col("pos").cast("long"), "n", "name"), "names"
    )
    number, ends = 0, []
    longest = level.agg(F.max("n")).first()[0] or 0
    while True:
        ends.append(level.where("n = 1").select("uid", F.lit(number).alias("level"), "name"))
        if longest <= 1:
            break
        level = _next_level(level)
        number, longest = number + 1, -(-longest // 2)
    ended = ends[0]
    for more in ends[1:]:
        ended = ended.unionAll(more)
    return documents.select("uid", "doc_id", "digest").join(ended.hint("merge"), "uid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, level, name)``, a row for each row of ``docs``.

    ``keep_id`` is the largest ``doc_id`` of the texts that are equal; ``kept`` marks one row of them.
    """
    rows = written(identities(docs, id_col, text_col, block_bytes), "identities")
    groups = written(
        rows.groupBy("level", "name").agg(
            F.max(F.struct("doc_id", "uid")).alias("keep"), F.count("*").alias("group_size")
        ),
        "groups",
    )
    return rows.join(sized(groups), ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "level", "name",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one of the largest ``doc_id``.

    Of rows with this id and equal text, which can differ in other columns and letter case only, the one whose values
    have the smallest hash stays.
    """
    found = exact_groups(docs)
    again = found.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times"), F.max("kept").alias("stays"))
    keep = written(again.where("stays").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"), "times"), "keep")
    text = F.translate(empty_text("row.text"), string.ascii_uppercase, string.ascii_lowercase)
    rows = whole_rows(docs, F.col("row.doc_id").cast("long").alias("id"), F.sha2(text, 256).alias("sha"))
    met = rows.join(sized(keep), rows["id"].eqNullSafe(F.col("keep_id")) & (rows["sha"] == F.col("keep_sha")))
    one = met.where("times > 1").groupBy("id", "sha").agg(F.min_by("row", F.struct("row.text", F.xxhash64("row"))).alias("row"))
    return met.where("times = 1").select("row.*").unionAll(one.select("row.*"))


def exact_query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents")).drop("level", "name")


EXACT_SQL = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
