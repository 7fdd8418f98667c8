"""Merkle manifest of a table: a tree for each group, a tree over their roots, proofs, and verification of seen rows.

A row's leaf is a hash of its fields. In each group (``lang``) leaves ascend by id, and every two consecutive nodes
(the last may be alone) become their hash until one is left, the group's subroot; subroots give the root likewise.

A tree is cut into superblocks of ``2 ** BLOCK_LEVELS`` consecutive nodes. Going up, each superblock becomes one node
of the next tier, until one is left. Going down, the nodes of each superblock are cogrouped with the outer nodes that
it needs, which is the proof of its own node: one ``applyInPandas`` reduces the superblock again, joins inner and outer
proof of each node and, for leaves, folds the proof of the row as seen now. So a group of any size is work of many
tasks, a task holds one superblock and one proof, and tiers shrink by a factor of ``2 ** BLOCK_LEVELS``.

Places in a tree come from sorting by range: each part counts its rows of a group, and sums of these counts (a row for
each part and group) give the place of the part's first row. Leaves are hashed while the table is scanned, and only
hashes are shuffled. Every step is written to the shared folder.

Nulls and edge cases: a null field reads ``-``, others their length in bytes, ``:`` and value, so that null and empty
differ. A null group is a group like others, before all of them. A null id comes before all numbers. Rows with equal
ids are ordered by leaf; equal leaves are interchangeable. Very long texts are hashed in the scan. An empty table gives
an empty result. Columns beside the fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from trustframe.llm.common import read_table, sized, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 8
TAMPER_STEP = 7
# Sorts before every group: a null one is this, others have a prefix that comes after it.
NULL_TREE, TREE_PREFIX = "-", "="
_ROOTS = "tree string, place long, total long, digest string"
_PATHS = "tree string, place long, path array<string>"
_PROOFS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def leaf_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value."""
    texts = [field.cast("string") for field in fields]
    parts = [F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, seen: dict[str, Column] | None = None, group: str = "lang", id_col: str = "doc_id",
           fields: Sequence[str] = FIELDS) -> DataFrame:
    """``(tree, doc_id, leaf, seen)`` of each row; ``seen`` replaces columns by their values at verification."""
    tree = F.coalesce(F.concat(F.lit(TREE_PREFIX), F.col(group).cast("string")), F.lit(NULL_TREE))
    leaf = leaf_hash([F.col(name) for name in fields])
    now = leaf_hash([seen.get(name, F.col(name)) for name in fields]) if seen else leaf
    return docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("doc_id"), leaf.alias("leaf"), now.alias("seen"))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Written ``rows`` with ``place`` (from 0, ascending by ``order``, null first) and ``total`` within ``tree``.

    Rows equal in ``order`` are spread by their number in the written table, so many of them are no hot key.
    """
    numbered = rows.withColumn("_number", F.monotonically_increasing_id())
    keys = ["tree", *order, "_number"]
    spread = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_number")
    sorted_rows = written(spread.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    counts = sorted_rows.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(
        counts.select("tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(tree).alias("total")),
        "starts",
    )
    rows = sorted_rows.withColumn("_part", part).join(sized(starts), ["tree", "_part"])
    return rows.withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def node_hash(left: str, right: str = "") -> str:
    return hashlib.sha256((left + right).encode()).hexdigest()


def _levels(digests: list[str], total: int, block_levels: int) -> list[list[str]]:
    """All levels of a superblock of a tree of ``total`` nodes, from its nodes to its single node."""
    levels = [digests]
    for _ in range(min(block_levels, (total - 1).bit_length())):
        below = levels[-1]
        levels.append([node_hash(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def _inner_path(levels: list[list[str]], at: int) -> list[str]:
    """Proof within a superblock: for each level ``L`` or ``R`` and the sibling on that side, or ``-`` without one."""
    path = []
    for level in levels[:-1]:
        other = at ^ 1
        path.append("-" if other >= len(level) else ("L" if other < at else "R") + level[other])
        at >>= 1
    return path


def fold(digest: str, path: Sequence[str]) -> str:
    """The root that a leaf and its proof lead to."""
    for step in path:
        if step == "-":
            digest = node_hash(digest)
        else:
            digest = node_hash(step[1:], digest) if step[0] == "L" else node_hash(digest, step[1:])
    return digest


def proof_hash(path: Sequence[str]) -> str:
    return hashlib.sha256("".join(step[1:] for step in path).encode()).hexdigest()


def _block(levels: int) -> Column:
    return F.shiftright("place", levels).alias("block")


def _go_up(nodes: DataFrame, block_levels: int) -> list[DataFrame]:
    """Tiers of superblock nodes above ``nodes (tree, place, total, digest)``; the last has one node for each tree."""

    def reduce_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        digests = block.sort_values("place")["digest"].tolist()
        total = int(block["total"].iloc[0])
        top = _levels(digests, total, block_levels)[-1][0]
        above = -(-total // (1 << block_levels))
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "total": [above], "digest": [top]})

    tiers = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        blocks = tiers[-1].select("tree", "place", "total", "digest", _block(block_levels)).groupBy("tree", "block")
        tiers.append(written(blocks.applyInPandas(reduce_block, _ROOTS), "tier"))
        most = -(-most // (1 << block_levels))
    return tiers


def _go_down(tiers: list[DataFrame], paths: DataFrame, block_levels: int) -> DataFrame:
    """Proofs ``(tree, place, path)`` of the first tier's nodes from those of the last tier's."""

    def join_paths(key: tuple, block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        levels = _levels(block["digest"].tolist(), int(block["total"].iloc[0]), block_levels)
        above = list(outer["path"].iloc[0])
        found = [_inner_path(levels, at) + above for at in range(len(block))]
        return pd.DataFrame({"tree": block["tree"], "place": block["place"], "path": found})

    for nodes in reversed(tiers[:-1]):
        blocks = nodes.select("tree", "place", "total", "digest", _block(block_levels)).groupBy("tree", "block")
        outer = paths.withColumnRenamed("place", "block").groupBy("tree", "block")
        paths = written(blocks.cogroup(outer).applyInPandas(join_paths, _PATHS), "paths")
    return paths


def _proved(block_levels: int, with_path: bool):
    """Reduces a superblock of leaves, joins its outer proof, and folds the leaves as seen."""

    def run(key: tuple, block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        digests = block["digest"].tolist()
        levels = _levels(digests, int(block["total"].iloc[0]), block_levels)
        subroot, root = outer["subroot"].iloc[0], outer["root"].iloc[0]
        above = list(outer["path"].iloc[0])
        ends: dict[str, str] = {}  # rows seen unchanged meet in the superblock's node, which is folded on once
        paths, folded = [], []
        for at, seen in enumerate(block["seen"]):
            inner = _inner_path(levels, at)
            met = fold(seen, inner)
            if met not in ends:
                ends[met] = fold(met, above)
            paths.append(inner + above)
            folded.append(ends[met])
        out = pd.DataFrame({"doc_id": block["doc_id"].astype("Int64"), "leaf": digests})
        out["subroot"], out["root"] = subroot, root
        out["proof_sha256"] = [proof_hash(path) for path in paths]
        out["folded_root"] = folded
        out["verified"] = out["folded_root"] == root
        if with_path:
            out["path"] = paths
        return out

    return run


def manifest(docs: DataFrame, seen: dict[str, Column] | None = None, group: str = "lang", id_col: str = "doc_id",
             fields: Sequence[str] = FIELDS, block_levels: int = BLOCK_LEVELS, with_path: bool = False) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each row, and ``path`` if wanted.

    ``seen`` maps columns to their values as verified now: ``folded_root`` is where that row and the original proof
    lead, ``verified`` whether it is the root. ``path`` has a step for each level up to the root (see ``_inner_path``).
    """
    rows = placed(written(leaves(docs, seen, group, id_col, fields), "leaves"), ["doc_id", "leaf"])
    rows = written(rows.withColumnRenamed("leaf", "digest"), "placed")
    tiers = _go_up(rows, block_levels)
    subroots = tiers[-1].select(F.col("tree").alias("of"), "digest")
    forest = placed(written(subroots.withColumn("tree", F.lit("")), "subroots"), ["of"])
    forest = written(forest, "forest")
    above = _go_up(forest, block_levels)
    root = above[-1].select(F.col("digest").alias("root"), "tree")
    top = _go_down(above, above[-1].select("tree", "place", F.array().cast("array<string>").alias("path")), block_levels)
    named = forest.join(top, ["tree", "place"]).join(sized(root), "tree")
    trees = written(named.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root"), "trees")
    tops = trees.select("tree", "place", "path")
    # Leaves take part in the last cogroup themselves, so the way down ends one tier above them.
    outer = _go_down(tiers[1:], tops, block_levels) if len(tiers) > 1 else tops
    outer = outer.join(sized(trees.select("tree", "subroot", "root")), "tree").withColumnRenamed("place", "block")
    blocks = rows.withColumn("block", F.shiftright("place", block_levels)).groupBy("tree", "block")
    schema = _PROOFS + (", path array<string>" if with_path else "")
    return blocks.cogroup(outer.groupBy("tree", "block")).applyInPandas(_proved(block_levels, with_path), schema)


def manifest_query(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, verified against a copy in which some rows have one character more."""
    docs = read_table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_STEP == 0
    return manifest(docs, {"n_chars": F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


def _leaf_sql(n_chars: str) -> str:
    texts = [f"CAST({n_chars if name == 'n_chars' else name} AS VARCHAR)" for name in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"


_HALVE = "list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))"
MANIFEST_SQL = f"""
WITH RECURSIVE c AS (
  SELECT *, xor(4294967295, list_reduce(
    [CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 1, 2, 3, 4, 5, 6, 7, 8],
      lambda v, w: CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END))) AS crc
  FROM documents
), h AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
    {_leaf_sql(f"(n_chars + CASE WHEN crc % {TAMPER_STEP} = 0 THEN 1 ELSE 0 END)")} AS seen FROM c
), d AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h
), t AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS l FROM d GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_HALVE} FROM t WHERE len(l) > 1
), s AS (
  SELECT lang, level AS height, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE len(l) = 1
), u AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS l FROM s
  UNION ALL SELECT level + 1, {_HALVE} FROM u WHERE len(l) > 1
), steps AS (
  SELECT rid, level, (d.pos >> level) % 2 AS odd, l[xor(d.pos >> level, 1) + 1] AS sibling
  FROM d JOIN t ON d.lang IS NOT DISTINCT FROM t.lang AND len(l) > 1
  UNION ALL SELECT rid, height + level, (s.pos >> level) % 2, l[xor(s.pos >> level, 1) + 1]
  FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang JOIN u ON len(l) > 1
), proofs AS (
  SELECT rid, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY level)) AS proof_sha256, count(*) AS n FROM steps GROUP BY rid
), v AS (
  SELECT rid, CAST(0 AS BIGINT) AS level, seen AS digest FROM d
  UNION ALL SELECT v.rid, v.level + 1,
    sha256(CASE WHEN odd = 1 THEN sibling || digest ELSE digest || coalesce(sibling, '') END)
  FROM v JOIN steps ON v.rid = steps.rid AND v.level = steps.level
)
SELECT doc_id, leaf, subroot, r.l[1] AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  v.digest AS folded_root, v.digest = r.l[1] AS verified
FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT l FROM u WHERE len(l) = 1) r ON true
LEFT JOIN proofs ON proofs.rid = d.rid JOIN v ON v.rid = d.rid AND v.level = coalesce(proofs.n, 0)
"""
