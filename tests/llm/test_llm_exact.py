"""Exact groups by block naming against a dictionary of normalised texts."""

from __future__ import annotations

import hashlib
import random

import pytest
from llm_tables import no_documents, odd_documents, odd_rows

from trustframe.llm import exact_dedup

SCHEMA = "doc_id long, text string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lowered(text), []).append(doc_id)
    out = []
    for doc_id, text in rows:
        same = groups[lowered(text)]
        keep = max(same, key=lambda d: (d is not None, d or 0))
        out.append((doc_id, keep, len(same), hashlib.sha256(lowered(text)).hexdigest()))
    return out


def key(rows):
    return sorted(map(repr, rows))


def check(frame, rows, block_bytes):
    found = exact_dedup.exact_groups(frame, block_bytes=block_bytes).collect()
    assert key((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == key(brute(rows))
    kept = [(r.doc_id, r.text_sha256) for r in found if r.kept]
    assert key(kept) == key({(keep, sha) for _, keep, _, sha in brute(rows)})
    names = {(r.level, r.name): r.text_sha256 for r in found}
    assert len(set(names.values())) == len(names) == len({lowered(t) for _, t in rows})  # one name a text, both ways


@pytest.mark.parametrize("block_bytes", [64, 512])
def test_odd_documents(spark, block_bytes):
    check(odd_documents(spark), [r[:2] for r in odd_rows()], block_bytes)


def test_shared_blocks_prefixes_and_heights(spark):
    """Texts of few letters share nearly all blocks and pairs; lengths cover full and odd trees of every height."""
    draw = random.Random(5)
    texts = ["ab" * n for n in range(20)] + ["ab" * n + "a" for n in range(20)]
    texts += ["".join(draw.choice("aAb") for _ in range(draw.randrange(40))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "hot copy of a text") for i in range(200)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(5), rows, 2)


def test_only_ascii_letters_change(spark):
    rows = [(1, "ÄB"), (2, "äb"), (3, "Äb"), (4, "İ"), (5, "i̇"), (6, "\x00A"), (7, "\x00a")]
    check(spark.createDataFrame(rows, SCHEMA), rows, 3)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(no_documents(spark)).count() == 0
    assert exact_dedup.drop_copies(no_documents(spark)).count() == 0


def test_drop_copies_keeps_whole_rows(spark):
    docs = odd_documents(spark)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    want = {(keep, sha) for _, keep, _, sha in brute([r[:2] for r in odd_rows()])}
    rows = kept.collect()
    assert key((r.doc_id, hashlib.sha256(lowered(r.text)).hexdigest()) for r in rows) == key(want)
    assert all(r["row"] == (None if r.doc_id is None else f"extra {r.doc_id}") for r in rows)
