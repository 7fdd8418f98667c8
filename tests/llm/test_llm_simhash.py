from __future__ import annotations

import random
import re

import pytest
import xxhash
from llm_tables import no_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from trustframe.llm import simhash_dedup


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes: list[int], radius: int) -> dict[int, int]:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_documents_with_nulls_repeats_and_extra_columns(spark):
    found = simhash_dedup.near_duplicates(odd_documents(spark)).collect()
    rows = odd_rows()
    assert len(found) == len(rows)
    prints = [plain_fingerprint(row[1]) for row in rows]
    linked = groups(sorted(set(prints)), 2)
    ids: dict[int, list[int]] = {}
    for row, fp in zip(rows, prints):
        ids.setdefault(linked[fp], []).append(row[0])
    want = sorted(
        (str(row[0]), fp, str(min([i for i in ids[linked[fp]] if i is not None], default=None)))
        for row, fp in zip(rows, prints)
    )
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in found) == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_connect_all_pairs_within_the_radius(spark, radius):
    rng = random.Random(radius)
    nodes = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(80):
        value = rng.choice(nodes)
        for _ in range(rng.randrange(4)):
            value ^= 1 << rng.randrange(64)
        nodes.append(value)
    nodes = sorted({n - (1 << 64) if n >> 63 else n for n in nodes})
    frame = spark.createDataFrame([(n,) for n in nodes], "fp long")
    links = simhash_dedup.linked(frame, radius).collect()
    assert all(((a ^ b) % (1 << 64)).bit_count() <= radius for a, b in links)
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {n: n for n in nodes}
    unsigned = {n % (1 << 64): n for n in nodes}
    for n, r in groups(sorted(unsigned), radius).items():
        want[unsigned[n]] = r
    same = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert same({n: find(n) for n in nodes}) == same(want)


def test_one_document_of_each_group_stays_with_its_columns(spark):
    docs = odd_documents(spark)
    kept = simhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.select("doc_id").collect())
    assert ids.count("5") == 1 and "6" not in ids  # repeated and near copies
    assert ids.count("1") == 1 and "8" not in ids  # exact copies
    assert ids.count("None") == 1
    assert kept.where(F.col("doc_id") == 1).first()["fp"] == "extra 1"


def test_empty_table(spark):
    assert simhash_dedup.near_duplicates(no_documents(spark)).count() == 0
    assert simhash_dedup.drop_near_duplicates(no_documents(spark)).count() == 0
