"""Benchmark decontamination: item-sized windows of documents against benchmark items, in column expressions only.

A window of as many words as an item is a leak if its five-word shingles reach a weighted similarity of 0.8 with the
item's: the weights of shared shingles over those of all shingles of both, where a shingle of many items weighs less.

1. A window can only be similar if it shares a shingle with the item, so shingles of all documents are looked up
   among those of the benchmark, and each hit places the item on the document: one window where they line up.
2. Every window gets a SimHash of its shingles. Fingerprints of items and windows of one size meet on equal blocks:
   with ``RADIUS + 1`` blocks all pairs within the radius share one. A pair is taken at its first equal block only.
3. Pairs within the radius are verified by the exact weighted similarity.

Copies of a passage cost a row each, never a pair of copies; a hit is a row, and only rows of one document meet again.
The benchmark is broadcast if its counted size allows and joined by shuffle otherwise.

Nulls and edge cases: words are rows of letters and digits, lower-cased. A null or wordless text or item takes no part.
An item below five words has one shingle, all of it. A document shorter than the item is one window. Repeated rows and
rows without id are worked on like others; the result has one row for each ``(doc_id, text, item_id)``. Items of equal
text all report. Empty tables give an empty result. Columns beside id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trustframe.llm.common import read_table, sized, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19


def word_array(text: Column) -> Column:
    """Lower-cased rows of letters and digits."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.trim(plain), " "), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Distinct shingles of up to five words; a shorter row of words is one shingle."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.slice(words, i + 1, SHINGLE))))


def fingerprint(grams: str) -> Column:
    """SimHash of an array of strings: the majority bits of their hashes."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (fp, b) -> fp | shiftleft(cast(2 * size(filter({grams}, g -> getbit(g, b) = 1))"
        f" > size({grams}) as bigint), b))"
    )


def block_masks(radius: int = RADIUS) -> list[int]:
    """Masks (signed) that cut 64 bits into ``radius + 1`` neighbouring blocks."""
    parts = radius + 1
    bounds = [64 * i // parts for i in range(parts + 1)]
    masks = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(bounds, bounds[1:])]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once for each row, however often later expressions name them."""
    packed = F.explode(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))).alias("_row")
    kept = df.select("*", packed)
    return kept.select(*df.columns, *[F.col(f"_row.{name}").alias(name) for name in columns])


def prepare_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(item_id, n, grams, weights, fp)``; ``weights`` are those of ``grams``, in order. Repeated items count once.

    Beside it ``(gram, less)`` of the shingles of several items: how far their weight is below that of a rare one.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), word_array(F.col(text_col)).alias("words"))
    rows = rows.where(F.size("words") > 0).select("item_id", "words", F.size("words").alias("n")).distinct()
    items = written(_held(rows, grams=shingles(F.col("words"))), "items")
    total = items.count()
    seen = items.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    weight = F.lit(1.0) + F.log(F.lit(float(total + 1)) / (F.col("df") + 1))
    parts = items.select("item_id", "n", "words", F.posexplode("grams").alias("at", "gram")).join(seen, "gram")
    packed = parts.groupBy("item_id", "n", "words").agg(F.sort_array(F.collect_list(F.struct("at", "gram", weight.alias("weight")))).alias("g"))
    made = packed.select("item_id", "n", "words", F.col("g.gram").alias("grams"), F.col("g.weight").alias("weights"))
    hashed = _held(made, hashes=F.transform("grams", lambda g: F.xxhash64(g)))
    top = 1.0 + float(_log((total + 1) / 2.0))
    common = written(seen.where("df > 1").select("gram", (F.lit(top) - weight).alias("less")), "common")
    made = hashed.select("item_id", "n", "words", "grams", "weights", fingerprint("hashes").alias("fp"), F.lit(top).alias("rare"))
    return written(made, "items"), common


def _log(x: float) -> float:
    from math import log

    return log(x)


def _gram_columns(words: Column, k: int) -> Column:
    """Each word with the ``k - 1`` that follow it, as an array of structs; short at the end."""
    shifted = [F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))) if i else words for i in range(k)]
    return F.arrays_zip(*[column.alias(f"w{i}") for i, column in enumerate(shifted)])


def _hits(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``(doc_id, text_hash, n, start)``: where a shared run of ``k`` words places an item of ``n`` words."""
    names = [f"_g.w{i}" for i in range(k)]

    def grams(rows: DataFrame, *keep: str) -> DataFrame:
        cut = _held(rows.select(*keep, "words"), g=_gram_columns(F.col("words"), k)).select(*keep, F.posexplode("g").alias("pos", "_g"))
        return cut.where(F.col(names[-1]).isNotNull()).select(*keep, "pos", F.xxhash64(*names).alias("_hash"))

    of_items = grams(items.where(F.least("n", F.lit(SHINGLE)) == k), "n").distinct().withColumnRenamed("pos", "_offset")
    known = sized(written(of_items, "grams"))
    found = grams(docs, "doc_id", "text_hash").join(known, "_hash")
    return found.select("doc_id", "text_hash", "n", F.greatest(F.col("pos") - F.col("_offset"), F.lit(0)).alias("start"))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, text_hash, item_id, similarity, start, n_windows)``: the best window of each leak, first of equals.

    ``start`` counts the document's words from 0.
    """
    items, common = prepare_items(benchmark)
    sizes = items.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect()  # five values at most
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    worded = _held(source, words=word_array(F.col("text"))).drop("text")
    hits = None
    for k in sorted(row["k"] for row in sizes):
        part = _hits(worded, items, k)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = worded.select("doc_id", "text_hash", F.lit(0).alias("n"), F.lit(0).alias("start")).where(F.lit(False))
    places = hits.distinct().groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("n", "start")).alias("places"))
    places = sized(written(places, "places").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}))
    same = worded["doc_id"].eqNullSafe(places["_id"]) & (worded["text_hash"] == places["_hash"])
    met = worded.join(places, same)
    cut = met.select("doc_id", "text_hash", F.transform("places", lambda p: F.struct(
        p["n"].alias("n"),
        F.least(p["start"], F.greatest(F.size("words") - p["n"], F.lit(0))).alias("start"),
        F.slice("words", F.least(p["start"], F.greatest(F.size("words") - p["n"], F.lit(0))) + 1, p["n"]).alias("words"),
    )).alias("windows"))
    windows = cut.select("doc_id", "text_hash", F.explode("windows").alias("w")).select("doc_id", "text_hash", "w.n", "w.start", "w.words")
    gramed = _held(windows.select("doc_id", "text_hash", "n", "start", "words"), w_grams=shingles(F.col("words"))).drop("words")
    hashed = _held(gramed, hashes=F.transform("w_grams", lambda g: F.xxhash64(g)))
    printed = _held(hashed, w_fp=fingerprint("hashes")).drop("hashes")
    return _verified(printed, items, common, similarity, radius)


def _verified(windows: DataFrame, items: DataFrame, common: DataFrame, similarity: float, radius: int) -> DataFrame:
    masks = block_masks(radius)
    mask_array = F.array(*[F.lit(mask) for mask in masks])

    def blocks(df: DataFrame, fp: str) -> DataFrame:
        cut = df.select("*", F.posexplode(mask_array).alias("block", "_mask"))
        return cut.withColumn("_part", F.col(fp).bitwiseAND(F.col("_mask"))).drop("_mask")

    of_items = sized(written(blocks(items.drop("words"), "fp"), "blocks"))
    pairs = blocks(windows, "w_fp").join(of_items, ["n", "block", "_part"])
    apart = F.col("fp").bitwiseXOR(F.col("w_fp"))
    earlier = F.exists(F.slice(mask_array, 1, F.col("block")), lambda mask: apart.bitwiseAND(mask) == 0)
    near = pairs.where(F.bit_count(apart) <= radius).where(~earlier)
    near = written(near.drop("fp", "w_fp", "block", "_part").withColumn("_pair", F.monotonically_increasing_id()), "near")
    beside = near.select("_pair", F.explode(F.array_except("w_grams", "grams")).alias("gram")).join(sized(common), "gram")
    near = near.join(beside.groupBy("_pair").agg(F.sum("less").alias("_less")), "_pair", "left")
    weighed = near.select(
        "doc_id", "text_hash", "item_id", "start",
        F.aggregate(
            F.arrays_zip(F.col("grams").alias("g"), F.col("weights").alias("w")), F.lit(0.0),
            lambda s, p: s + F.when(F.array_contains("w_grams", p["g"]), p["w"]).otherwise(0.0),
        ).alias("_shared"),
        F.aggregate("weights", F.lit(0.0), lambda s, w: s + w).alias("_item"),
        (F.size(F.array_except("w_grams", "grams")) * F.col("rare") - F.coalesce("_less", F.lit(0.0))).alias("_other"),
    )
    scored = weighed.select("doc_id", "text_hash", "item_id", "start", (F.col("_shared") / (F.col("_item") + F.col("_other"))).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("_first")))
    kept = scored.where(F.col("similarity") >= similarity - 1e-9)
    return (
        kept.groupBy("doc_id", "text_hash", "item_id")
        .agg(best.alias("_best"), F.countDistinct("start").alias("n_windows"))
        .select("doc_id", "text_hash", "item_id", F.col("_best.similarity").alias("similarity"), (-F.col("_best._first")).alias("start"), "n_windows")
    )


def decontaminate_query(spark, sf_dir: str) -> DataFrame:
    found = leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start", "n_windows")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    bad = sized(written(found, "leaks"))
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"])
    return docs.join(bad, same, "left_anti")
