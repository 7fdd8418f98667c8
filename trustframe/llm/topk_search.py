"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of near equal lengths (chunks of a few thousand rows). For a query
whose k-th best product so far is t, a bucket with longest vector l needs a cosine of at least t / (|q| l). Above 1 the
whole bucket is skipped. A high threshold prunes by coordinates: at the query's largest coordinates a vector of that
cosine must lie in a known interval, found by binary search in the bucket's sorted coordinates. A low threshold prunes
by length: only the vectors long enough are looked at. What is left is verified by exact integer products.

Every query meets every bucket once: queries travel in packed blocks to the groups of buckets (a bounded number of
tasks), pairs of block and bucket are scored as they stream by, and each task passes on its k best of each query only.
The product of queries and rows is split over tasks by buckets, so no bucket, copy group or common vector is held by
one task, and nothing grows with a group.

Nulls and edge cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
without ``vec_id``. Vectors of different sizes never meet. A row is no candidate of itself, but a repeated row (same
id) is. Scaled components saturate at the range of a long, and products wrap like long arithmetic where they leave it;
below 2^53 they are computed in doubles, which is exact. Ties go to the smaller ``vec_id``. An empty table gives an
empty result. Columns beside id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trustframe.llm.common import written

K = 5
SCALE = 256.0
QUERY_STEP = 50
CHUNK_ROWS = 4096
BLOCK_ROWS = 512
GROUPS = 48
# A bucket is pruned by coordinates from this cosine threshold on, by length below it; and so many coordinates are used.
COORDINATE_COSINE = 0.6
FOCUS = 3
EXACT = float(1 << 53)


def quantised(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """``(vec_id, vector array<long>, dims, norm)`` of the rows that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & (F.size(x) > 0) & finite)
    vector = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    sized = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    return sized.select("vec_id", "vector", F.size("vector").alias("dims"), norm.alias("norm"))


def _packed(rows: DataFrame, most: int, by_length: bool) -> DataFrame:
    """Pack rows of one size into binary blocks ``(dims, n, ids, uids, data)`` of at most ``most`` rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for size in np.unique(dims):
                at = np.flatnonzero(dims == size)
                for lo in range(0, len(at), most):
                    part = batch.take(pa.array(at[lo : lo + most]))
                    data = part.column("vector").flatten().to_numpy().astype("<i8")
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dims": pa.array([int(size)], pa.int32()),
                            "n": pa.array([part.num_rows], pa.int32()),
                            "ids": [part.column("vec_id").to_numpy().astype("<i8").tobytes()],
                            "uids": [part.column("uid").to_numpy().astype("<i8").tobytes()],
                            "data": [_narrow(data)],
                        }
                    )

    if by_length:
        rows = rows.repartitionByRange("dims", F.col("norm").desc()).sortWithinPartitions("dims", F.col("norm").desc())
    return rows.mapInArrow(pack, "dims int, n int, ids binary, uids binary, data binary")


def _narrow(data: np.ndarray) -> bytes:
    """Vectors as two-byte integers where they fit; the first byte tells the width."""
    fits = len(data) == 0 or (data.min() >= -(1 << 15) and data.max() < 1 << 15)
    return b"\x02" + data.astype("<i2").tobytes() if fits else b"\x08" + data.tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i2" if data[0] == 2 else "<i8", offset=1).reshape(n, -1)


class Bucket:
    """One bucket: vectors by falling length, with sorted coordinates made when a query first needs them."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, vectors: np.ndarray):
        exact = vectors.astype(np.float64)
        norms = np.sqrt((exact * exact).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.uids, self.norms = ids[order], uids[order], norms[order]
        self.values, self.whole = exact[order], vectors[order]
        self.longest = float(self.norms[0])
        unit = np.where(self.norms > 0, self.norms, 1.0)
        self.unit = self.values / unit[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.largest = float(np.abs(exact).max(initial=0.0))

    def _coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = (order, self.unit[order, f])
        return self.sorted[f]

    def candidates(self, query: np.ndarray, length: float, least: float) -> np.ndarray | slice:
        """Rows whose product with the query can reach ``least``."""
        if length == 0 or least <= 0:
            return slice(0, len(self.ids)) if least <= 0 else slice(0, 0)
        slack = 1e-9
        cosine = least / (length * self.longest) - slack if self.longest > 0 else 2.0
        if cosine > 1:
            return slice(0, 0)
        if cosine < COORDINATE_COSINE:
            return slice(0, int(np.searchsorted(-self.norms, -(least / length) * (1 - slack), side="right")))
        unit = query / length
        kept: np.ndarray | None = None
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            spread = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - unit[f] * unit[f])))
            low, high = unit[f] * cosine - spread - slack, unit[f] * cosine + spread + slack
            if unit[f] >= cosine:  # the vector along the query's own coordinate allows all beyond
                high = 1.0 + slack
            if -unit[f] >= cosine:
                low = -1.0 - slack
            if kept is None:
                order, values = self._coordinate(int(f))
                kept = order[np.searchsorted(values, low) : np.searchsorted(values, high, side="right")]
            else:
                column = self.unit[kept, f]
                kept = kept[(column >= low) & (column <= high)]
        return kept

    def products(self, query: np.ndarray, whole: np.ndarray, rows) -> np.ndarray:
        if self.largest * float(np.abs(query).max(initial=0.0)) * max(1, len(query)) < EXACT:
            return (self.values[rows] @ query).astype(np.int64)
        with np.errstate(over="ignore"):
            return (self.whole[rows].astype(np.int64) * whole.astype(np.int64)).sum(axis=1)


class Best:
    """The k best of one query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(self.score) == self.k:
            better = score >= self.score[-1]
            score, ids = score[better], ids[better]
        if len(score):
            score, ids = np.r_[self.score, score], np.r_[self.ids, ids]
            order = np.lexsort((ids, -score))[: self.k] if len(score) < 64 else self._first(score, ids)
            self.score, self.ids = score[order], ids[order]

    def _first(self, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        least = np.partition(score, len(score) - self.k)[len(score) - self.k] if len(score) > self.k else score.min()
        at = np.flatnonzero(score >= least)
        return at[np.lexsort((ids[at], -score[at]))[: self.k]]

    @property
    def least(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], Best] = {}
        held: tuple[bytes, Bucket] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                key = row["uids"]
                if held is None or held[0] != key:
                    vectors = _unpack(row["data"], row["n"])
                    held = (key, Bucket(np.frombuffer(row["ids"], "<i8"), np.frombuffer(key, "<i8"), vectors))
                bucket = held[1]
                queries = _unpack(row["q_data"], row["q_n"])
                q_ids, q_uids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_uids"], "<i8")
                values = queries.astype(np.float64)
                lengths = np.sqrt((values * values).sum(axis=1))
                for i, (q_id, q_uid) in enumerate(zip(q_ids.tolist(), q_uids.tolist())):
                    top = best.setdefault((q_uid, q_id), Best(k))
                    rows = bucket.candidates(values[i], float(lengths[i]), top.least)
                    ids = bucket.ids[rows]
                    if len(ids):
                        own = bucket.uids[rows] == q_uid
                        score = bucket.products(values[i], queries[i], rows)
                        top.add(score[~own], ids[~own])
        found = [(uid, q_id, v, s) for (uid, q_id), top in best.items() for v, s in zip(top.ids.tolist(), top.score.tolist())]
        for lo in range(0, len(found), 50_000):
            columns = list(zip(*found[lo : lo + 50_000]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["uid", "query_id", "vec_id", "score"]
            )

    return run


def top_k(table: DataFrame, k: int = K, step: int = QUERY_STEP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best other rows of each row whose id is divisible by ``step``."""
    rows = written(quantised(table, id_col, vector_col).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    chunks = _packed(rows, CHUNK_ROWS, True).withColumn("group", (F.monotonically_increasing_id() % GROUPS).cast("int"))
    queries = rows.where(F.col("vec_id") % step == 0)
    blocks = _packed(queries, BLOCK_ROWS, False).select(
        "dims", *[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "uids", "data")], F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("group")
    )
    pairs = chunks.join(blocks.hint("merge"), ["group", "dims"])
    found = pairs.mapInArrow(_score(k), "uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def topk_query(spark, sf_dir: str) -> DataFrame:
    from trustframe.llm.common import read_table

    return top_k(read_table(spark, sf_dir, "embeddings"))


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
