"""Ranked lexical search of many queries at once, by evaluating what they share only once.

Queries (items) are sets of terms. ``share`` mines term sets that several items hold: terms of the same items become
one node, then the pair of nodes that most items hold together becomes a node, round by round. The result is a
directed graph: nodes add up terms and earlier nodes, items add up nodes. A document's accumulator of a node is the sum
of its term scores below it; it is computed once for each document and combined along the graph into the scores of all
items, for a block of documents at a time in integer arrays.

Scale: one scan of the texts writes, for each document, its length and its counts of query terms (a fraction of the
text); document frequencies and corpus sums come from that table, and scoring reads it again. A task keeps the best
``k`` documents of each item and passes on only those, so nothing grows with a group of equal documents or a frequent
term. Items are worked on in blocks whose terms have a checked size (``BLOCK_BYTES``; a single item may be larger),
because these travel to all tasks. All items of all blocks are scored against all documents.

Scores are integers: the weight of a term is ``floor(1000 ln((2N + 2) / (2df + 1)))`` and a document adds
``w * ((1000000000 tf) div (1000 tf + 8m))`` with ``m = 10 + (90 n N) div L``; ``m`` is worked out without overflow.

Nulls and edge cases: a null text has no terms, and documents without terms are not counted in ``N``. Equal ``item_id``
(a null one too) are one item with the terms of all its rows. Repeated documents are ranked each for itself; equal
scores are in order of ``doc_id``, null last. Very long texts are counted whole, one slice of text at a time. An empty
table gives an empty result. Columns beside ids and texts are not read.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trustframe.llm.common import map_slices, read_table, written

K = 10
BLOCK_BYTES = 8 * 1024 * 1024
# Bytes of accumulators that a task holds at a time.
ARRAY_BYTES = 48 * 1024 * 1024
# Bounds of mining; they change how much is shared, never a result.
PAIR_WIDTH = 64
PAIR_ROUNDS = 64
NO_ID = np.iinfo(np.int64).max

_LETTERS = string.ascii_letters + string.digits
_TO_TERMS = bytes(
    b if b >= 128 else ord(chr(b).lower()) if chr(b) in _LETTERS else ord(" ") for b in range(256)
)


def terms(text: str | bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all other than ASCII characters; only A-Z change to lower case."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_TO_TERMS).split()


@dataclass(frozen=True)
class Sharing:
    """``nodes[i]`` lists what number ``n_terms + i`` adds up; ``queries[j]`` what the j-th item adds up."""

    n_terms: int
    nodes: tuple[tuple[int, ...], ...]
    queries: tuple[tuple[int, ...], ...]

    def additions(self) -> int:
        return sum(len(node) - 1 for node in self.nodes) + sum(max(0, len(query) - 1) for query in self.queries)


def share(items: list[set[int]], n_terms: int) -> Sharing:
    """Mine shared term sets of ``items`` and express each item by them."""
    holders = defaultdict(set)
    for j, item in enumerate(items):
        for term in item:
            holders[term].add(j)
    queries = [set(item) for item in items]
    nodes: list[tuple[int, ...]] = []

    def replace(parts: tuple[int, ...], inside: set[int]) -> None:
        new = n_terms + len(nodes)
        nodes.append(parts)
        for j in inside:
            queries[j].difference_update(parts)
            queries[j].add(new)
        for part in parts:
            holders[part] -= inside
        holders[new] = set(inside)

    alike = defaultdict(list)
    for term in sorted(holders):
        alike[frozenset(holders[term])].append(term)
    for inside, same in sorted(alike.items(), key=lambda group: group[1]):
        if len(inside) > 1 and len(same) > 1:
            replace(tuple(same), set(inside))
    for _ in range(PAIR_ROUNDS):
        together: Counter = Counter()
        for query in queries:
            shared = sorted((s for s in query if len(holders[s]) > 1), key=lambda s: (-len(holders[s]), s))
            for at in range(0, len(shared), PAIR_WIDTH):
                together.update((min(p), max(p)) for p in combinations(shared[at : at + PAIR_WIDTH], 2))
        used: set[int] = set()
        for pair, times in sorted(together.items(), key=lambda found: (-found[1], found[0])):
            if times > 1 and used.isdisjoint(pair):
                used.update(pair)
                replace(pair, holders[pair[0]] & holders[pair[1]])
        if not used:
            break
    return Sharing(n_terms, tuple(nodes), tuple(tuple(sorted(query)) for query in queries))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``(item_id, term)``."""

    def run(part: pa.RecordBatch) -> dict:
        pairs = [(i, t) for i, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist()) for t in set(terms(text))]
        return {"item_id": [i for i, _ in pairs], "term": [t for _, t in pairs]}

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return map_slices(rows, run, "item_id long, term binary").distinct()


def _in_blocks(pairs: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """``pairs`` with the number of their item's block, and the number of blocks.

    Items are dealt out by hash to so many blocks that none is larger than ``limit`` bytes, unless a single item is.
    """
    width = F.sum(F.octet_length("term") + 16)
    blocks = max(1, -(-(pairs.agg(width.alias("b")).first()["b"] or 0) // limit))
    while True:
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
        sizes = dealt.groupBy("block").agg(width.alias("b"), F.countDistinct("item_id").alias("n"))
        if blocks == 1 or sizes.where((F.col("b") > limit) & (F.col("n") > 1)).isEmpty():
            return dealt, blocks
        blocks *= 2


def term_counts(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, ids, tfs)`` of documents with a term: their length and counts of the vocabulary's terms."""
    number = {term: i for i, term in enumerate(vocabulary)}

    def run(part: pa.RecordBatch) -> dict:
        columns = {"doc_id": [], "n": [], "ids": [], "tfs": []}
        texts = part.column("text").cast(pa.binary()).to_pylist()
        for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
            found = terms(text)
            if found:
                hits = [(number[t], tf) for t, tf in Counter(found).items() if t in number]
                columns["doc_id"].append(doc_id)
                columns["n"].append(len(found))
                columns["ids"].append([i for i, _ in hits])
                columns["tfs"].append([tf for _, tf in hits])
        return columns

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(rows, run, "doc_id long, n long, ids array<int>, tfs array<long>")


def _lengths(ns: list[int], documents: int, length: int) -> np.ndarray:
    return np.array([10 + 90 * n * documents // length for n in ns], dtype=np.int64)


class _Best:
    """The ``k`` best documents of each item among those seen: score descending, then id ascending."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.scores = [np.empty(0, np.int64)] * items
        self.ids = [np.empty(0, np.int64)] * items
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        better = scores >= self.least[:, None]
        for j in np.flatnonzero(better.any(axis=1)):
            score = np.concatenate([self.scores[j], scores[j, better[j]]])
            doc = np.concatenate([self.ids[j], ids[better[j]]])
            order = np.lexsort((doc, -score))[: self.k]
            self.scores[j], self.ids[j] = score[order], doc[order]
            if len(order) == self.k:
                self.least[j] = self.scores[j][-1]


def _score(sharing: Sharing, weights: np.ndarray, items: list, documents: int, length: int, k: int):
    """Scores all items against streamed documents, a block of accumulators at a time."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    width = sharing.n_terms + len(sharing.nodes) + len(sharing.queries)
    step = max(1, ARRAY_BYTES // (8 * width))
    nodes = [np.array(node) for node in sharing.nodes]
    queries = [np.array(query, dtype=np.int64) for query in sharing.queries]

    def accumulate(part: pa.RecordBatch) -> np.ndarray:
        n = part.num_rows
        sums = np.zeros((sharing.n_terms + len(nodes), n), np.int64)
        hits, tfs = part.column("ids"), part.column("tfs").flatten().to_numpy()
        at = np.repeat(np.arange(n), np.diff(hits.offsets.to_numpy()))
        ids = hits.flatten().to_numpy()
        m = _lengths(part.column("n").to_pylist(), documents, length)[at]
        sums[ids, at] = weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))
        for i, node in enumerate(nodes):
            np.add.reduce(sums[node], axis=0, out=sums[sharing.n_terms + i])
        return np.array([np.add.reduce(sums[query], axis=0) for query in queries])

    def run(batches):
        best = _Best(len(items), k)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
                best.add(accumulate(part), ids)
        found = [(items[j], d, s) for j in range(len(items)) for d, s in zip(best.ids[j].tolist(), best.scores[j].tolist())]
        columns = [[f[0] for f in found], [None if f[1] == NO_ID else f[1] for f in found], [f[2] for f in found]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def _search_block(docs: DataFrame, pairs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """Each task's best documents of the items in ``pairs``, which are one block; None without documents or terms."""
    held = defaultdict(set)
    for row in pairs.select("item_id", "term").toArrow().to_pylist():
        held[row["item_id"]].add(row["term"])
    vocabulary = sorted(set().union(*held.values())) if held else []
    if not vocabulary:
        return None
    number = {term: i for i, term in enumerate(vocabulary)}
    items = sorted(held, key=lambda item: (item is None, item))
    counts = written(term_counts(docs, vocabulary, id_col, text_col), "term-counts")
    corpus = counts.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    if not corpus["documents"]:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for row in counts.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a row for each term
        df[row["id"]] = row["count"]
    weights = [math.floor(1000 * math.log((2 * corpus["documents"] + 2) / (2 * int(d) + 1))) for d in df]
    sharing = share([{number[term] for term in held[item]} for item in items], len(vocabulary))
    score = _score(sharing, np.array(weights, np.int64), items, corpus["documents"], corpus["length"], k)
    return counts.mapInArrow(score, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id",
           doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of the highest positive score for each item."""
    pairs, blocks = _in_blocks(written(item_terms(items, item_id, item_text), "item-terms"), block_bytes)
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        best = _search_block(docs, pairs.where(F.col("block") == block), k, doc_id, doc_text)
        found = found if best is None else found.unionAll(best)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search_query(spark, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS_SQL = (
    "regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
).format(upper=string.ascii_uppercase, lower=string.ascii_lowercase)
SEARCH_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_TERMS_SQL} AS terms FROM documents
), n AS (
  SELECT rid, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0
), c AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n
), m AS (
  SELECT rid, doc_id, 100 - 90 + ((90 * n * docs) // total) AS m FROM n, c
), tf AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY rid, term
), q AS (
  SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c
), s AS (
  SELECT item_id, doc_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY item_id, doc_id, rid
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {K}
"""
