"""The manifest against one list of hashes for each level."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from llm_tables import no_documents, odd_documents
from pyspark.sql import functions as F

from trustframe.llm import merkle_manifest as merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, **changed):
    row = row.asDict() | changed
    return sha(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in merkle.FIELDS])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, at):
    """``(siblings before, siblings after)`` of each level."""
    out = []
    for level in levels[:-1]:
        start = at - at % 2
        out.append((level[start:at], level[at + 1 : start + 2]))
        at //= 2
    return out


def brute(rows, tampered):
    groups = {}
    for row in rows:
        groups.setdefault(row.lang, []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for lang in order:
        groups[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees.append(tree([leaf(r) for r in groups[lang]]))
    top = tree([levels[-1][0] for levels in trees])
    out = []
    for place, (lang, levels) in enumerate(zip(order, trees)):
        for at, row in enumerate(groups[lang]):
            steps = siblings(levels, at) + siblings(top, place)
            digest = leaf(row, n_chars=row.n_chars + 1) if tampered(row) and row.n_chars is not None else leaf(row)
            for before, after in steps:
                digest = sha(*before, digest, *after)
            proof = sha(*[s for before, after in steps for s in before + after])
            out.append((row.doc_id, leaf(row), levels[-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return sorted(map(repr, out))


def chosen(row):
    return row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 0


def seen():
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return {"n_chars": F.when(picked, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


FIELDS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def check(docs, **options):
    found = merkle.manifest(docs, seen(), **options).select(*FIELDS).collect()
    rows = docs.select(*merkle.FIELDS).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows, chosen)


def test_odd_documents(spark):
    check(odd_documents(spark), block_levels=1)


@pytest.mark.parametrize("block_levels", [1, 2, 8])
def test_many_tiers(spark, block_levels):
    """Groups of 1, 2, 3, 5, 37 and 64 rows: trees of several tiers beside trees of one node, a hot group, null groups."""
    sizes = {None: 5, "": 3, "a": 37, "B": 1, "é": 64, "b": 2}
    rows = [(i, lang, f"text {i}", "s" if i % 2 else None, i if i % 5 else None) for i, lang in enumerate(l for l, n in sizes.items() for _ in range(n))]
    check(spark.createDataFrame(rows, "doc_id long, lang string, text string, source string, n_chars long").repartition(7), block_levels=block_levels)


def test_repeated_rows_and_one_row(spark):
    schema = "doc_id long, lang string, text string, source string, n_chars long"
    check(spark.createDataFrame([(7, "en", "same", "s", 4)] * 50 + [(7, "en", "other", "s", 5)], schema), block_levels=2)
    check(spark.createDataFrame([(0, None, None, None, None)], schema))


def test_paths_fold_to_the_root(spark):
    rows = merkle.manifest(odd_documents(spark), block_levels=1, with_path=True).collect()
    assert rows and all(merkle.fold(r.leaf, r.path) == r.root and r.verified for r in rows)
    assert all(merkle.proof_hash(r.path) == r.proof_sha256 for r in rows)


def test_empty_table(spark):
    assert merkle.manifest(no_documents(spark)).count() == 0
