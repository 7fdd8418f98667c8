"""Near duplicates of documents by SimHash and meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius share a
variant, so one shuffle on variants brings every such pair together. The fingerprints that share a variant are at
most as many as there are variants of one fingerprint (65 for radius 2), whatever the number of documents: copies
have met in their common fingerprint before.

Nulls and edge cases: a null text has no words and, like an empty one, fingerprint zero, which links like any other.
A null ``doc_id`` takes part in links and never names a component, unless all documents of it have none. Repeated
rows stay repeated in the result of ``near_duplicates``. An empty table gives an empty result. Columns beside id and
text are not read; ``drop_near_duplicates`` hands them on.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trustframe.llm.common import components, map_slices, read_table, whole_rows, written

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2


def text_fingerprints(texts: list[str | None], shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """SimHash of each text, unsigned 64 bit: the majority bits of its shingles' XXH64, repeats included."""
    hashes: list[int] = []
    ends = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = (text or "").encode("utf-8").lower().split()  # of bytes: only A-Z change, only ASCII space splits
        if words:
            if len(words) < shingle_words:
                hashes.append(digest(b" ".join(words), SEED))
            else:
                shifted = (words[i:] for i in range(shingle_words))
                hashes.extend([digest(b" ".join(shingle), SEED) for shingle in zip(*shifted)])
        ends.append(len(hashes))
    counts = np.diff(np.array([0, *ends]))
    out = np.zeros(len(texts), dtype=np.uint64)
    filled = np.flatnonzero(counts)
    if len(filled):
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = (np.array(ends) - counts)[filled]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        majority = ones * 2 > counts[filled][:, None]
        out[filled] = np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)`` of each row; ``fp`` is the 64 bit fingerprint as a signed long."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )

    def run(part: pa.RecordBatch) -> dict:
        found = text_fingerprints(part.column(2).to_pylist())
        return {"doc_id": part.column(0), "text_hash": part.column(1), "fp": found.view(np.int64)}

    return map_slices(rows, run, "doc_id long, text_hash long, fp long")


def _flips(bits: int, most: int) -> list[int]:
    """Signed 64 bit masks with up to ``most`` of ``bits`` bits set, the empty one included."""
    masks = [sum(1 << i for i in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]
    return [mask - (1 << 64) if mask >= 1 << 63 else mask for mask in masks]


def linked(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: links among distinct fingerprints ``fp`` that connect all pairs within ``radius`` bits.

    With an even radius all fingerprints of a variant lie within the radius of each other, and links to the smallest
    one connect them. With an odd radius all pairs of a variant are checked; their number is bounded by the variants.
    """
    if radius % 2:
        return ball_pairs(fps, radius)
    pairs = _met(fps, radius).select(F.col("_members")[0].alias("a"), F.explode(F.slice("_members", 2, 1 << 30)).alias("b"))
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def ball_pairs(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``, a < b: all pairs of distinct fingerprints ``fp`` within ``radius`` bits."""
    pairs = _met(fps, radius).select(F.posexplode("_members").alias("_at", "a"), "_members").select(
        "a", F.explode(F.expr("slice(_members, _at + 2, size(_members))")).alias("b")
    )
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _met(fps: DataFrame, radius: int) -> DataFrame:
    """``(_variant, _members)``: fingerprints, in order, that share a variant within half the radius."""
    half = -(-radius // 2)
    masks = F.array(*[F.lit(mask) for mask in _flips(64, half)])
    ball = fps.select("fp", F.explode(masks).alias("_flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("_flip")).alias("_variant")
    )
    met = ball.groupBy("_variant").agg(F.sort_array(F.collect_set("fp")).alias("_members"))
    return met.where(F.size("_members") > 1)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id, first)``, a row for each row of ``docs``.

    ``component_id`` is the smallest id among the documents that links reach; ``first`` is the ``(doc_id, text_hash)``
    of the one to keep.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    first = F.min(F.struct("doc_id", "text_hash"))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("_id"), first.alias("_first")), "nodes")
    roots = components(linked(nodes.select("fp"), radius), "a", "b").select(F.col("node").alias("fp"), "component")
    rooted = nodes.join(roots, "fp", "left").withColumn("_root", F.coalesce("component", "fp"))
    least = rooted.groupBy("_root").agg(F.min("_id").alias("component_id"), F.min("_first").alias("first"))
    named = rooted.select("fp", "_root").join(least, "_root").drop("_root")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "first")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest ``doc_id`` (null before all numbers)."""
    found = near_duplicates(docs, radius=radius)
    keep = found.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")).distinct()
    rows = whole_rows(docs, F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("hash"))
    same = rows["id"].eqNullSafe(keep["_id"]) & (rows["hash"] == keep["_hash"])
    return rows.join(keep, same, "left_semi").dropDuplicates(["id", "hash"]).select("row.*")


def simhash_query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
