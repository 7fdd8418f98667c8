"""Line dedup, passage removal, decontamination and the pipeline against brute force."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import Counter

import pytest
import regex
from llm_tables import CLASHES, no_documents, odd_documents, odd_rows, write_tables
from pyspark.sql import functions as F

from trustframe.llm import decontaminate, line_dedup, substring_dedup
from trustframe.llm.common import read_table

SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """The plain table, only its band of cells that can stay within ``most``."""
    most = max(len(a), len(b)) if most is None else most
    far = most + 1
    before = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        low, high = max(0, i - most), min(len(b), i + most + 1)
        now = [far] * (len(b) + 1)
        now[0] = i + 1
        for j in range(low, high):
            now[j + 1] = min(before[j] + (x != b[j]), before[j + 1] + 1, now[j] + 1, far)
        before = now
        if min(now) > most:
            return far
    return before[-1]


# ---- lines


def normal(line: str) -> str:
    return " ".join(regex.findall(r"[\p{L}\p{N}]+", line.lower()))


@functools.lru_cache(None)
def trigrams(line: str) -> frozenset:
    return frozenset(line[i : i + 3] for i in range(len(line) - 2))


def alike(a: str, b: str) -> bool:
    most = 0.2 * max(len(a), len(b)) + 1e-9
    if abs(len(a) - len(b)) > most:
        return False
    x, y = trigrams(a), trigrams(b)  # an edit takes away three of them at most
    return len(x & y) >= max(len(x), len(y)) - 3 * most and edit_distance(a, b, int(most)) <= most


def line_places(docs: list[tuple[int, str | None]]) -> dict[str, list]:
    places: dict[str, list] = {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        for i, line in enumerate((text or "").split("\n")):
            if normal(line):
                places.setdefault(normal(line), []).append((doc, i))
    return places


def plain_lines(docs: list[tuple[int, str | None]]) -> dict:
    """By edit similarity of all pairs alone: no fingerprint."""
    places = line_places(docs)
    root = {line: line for line in places}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = list(places)
    for i, a in enumerate(names):
        for b in names[:i]:
            if alike(a, b):
                root[find(a)] = find(b)
    first: dict[str, tuple] = {}
    for line, at in places.items():
        first[find(line)] = min(first.get(find(line), at[0]), *at)
    gone = {p for line, at in places.items() for p in at if p != first[find(line)]}
    return {
        d: (0 if t is None else len(t.split("\n")), sum(1 for i in range(len((t or "").split("\n"))) if (d, i) in gone),
            sha("\n".join(line for i, line in enumerate((t or "").split("\n")) if (d, i) not in gone)))
        for d, t in docs
    }


def line_groups(spark, docs: list[tuple[int, str | None]]) -> dict[str, object]:
    """Group of each distinct normalised line, by the operator."""
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    source = line_dedup._source(frame, "doc_id", "text")
    lines = line_dedup.written(line_dedup.fingerprinted(source), "lines")
    group = {r.node: r.component for r in line_dedup.components(line_dedup.similar_lines(source, lines), "node", "lead").collect()}
    at = {(r.doc_id, r.line_no): r.k1 for r in lines.collect()}
    return {line: group.get(at[where[0]], at[where[0]]) for line, where in line_places(docs).items()}


def lines_found(docs) -> dict:
    kept = line_dedup.dedup_lines(docs).collect()
    return {r.row.doc_id: (r.n_lines, r.n_removed, sha(r.row.text or "")) for r in kept}


def line_documents() -> list[tuple[int, str | None]]:
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 20, 30, 126, 127, 128, 300)]
    docs: list[tuple[int, str | None]] = [(1000, None), (1001, ""), (1002, "\n\n--\n")]
    for doc in range(18):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base).split(" ")
            for _ in range(rng.randrange(3)):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(rng.choice(["", "  ", "- "]) + " ".join(line).upper() + rng.choice(["", ".", "!!"]))
        docs.append((doc, "\n".join(lines)))
    return docs


def test_lines_equal_brute_force(spark):
    docs = line_documents()
    assert lines_found(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == plain_lines(docs)


def test_recall_on_the_given_lines(spark):
    """Pairs of edit similarity 0.8 or more that end in one group, and no group without such a link."""
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    group = line_groups(spark, docs)
    names = [line for line in group if len(line) < 300]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i] if alike(a, b)]
    met = sum(group[a] == group[b] for a, b in pairs)
    assert len(pairs) > 10 and met >= 0.9 * len(pairs)
    linked = {line for pair in pairs for line in pair}
    sizes = Counter(group[line] for line in names)
    assert all(sizes[group[line]] == 1 for line in names if line not in linked)


def test_recall_after_changes(spark):
    """One changed word of a short line, one in ten of a longer one, taken out or put in as often as replaced."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    docs, pairs = [], {}
    for n in (3, 9, 33, 97):
        for _ in range(30):
            a = [word() for _ in range(n)]
            b = list(a)
            for _ in range(max(1, n // 10)):
                at = rng.randrange(len(b))
                b[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
            docs += [(len(docs), " ".join(a)), (len(docs) + 1, " ".join(b).upper())]
            if alike(" ".join(a), " ".join(b)):
                pairs.setdefault(n, []).append((" ".join(a), " ".join(b)))
    group = line_groups(spark, docs)
    for n, some in pairs.items():
        assert sum(group[a] == group[b] for a, b in some) >= 0.9 * len(some), n


def test_recall_of_short_lines(spark):
    """Typos in lines of one or two words of any length, changes of two words of few, and in one word of ten of long ones."""
    rng = random.Random(13)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    docs, pairs = [], {}

    def add(kind, a: str, b: str) -> None:
        docs.extend([(len(docs), a), (len(docs) + 1, b.upper())])
        assert alike(a, b)
        pairs.setdefault(kind, []).append((a, b))

    def typos(text: str, n: int) -> str:
        for at in sorted(rng.sample(range(len(text)), n), reverse=True):
            text = text[:at] + rng.choice(["", letters(1), text[at] + letters(1)]) + text[at + 1 :]
        return text

    for _ in range(12):
        for n, edits in ((12, 2), (14, 2), (22, 2), (40, 3), (64, 5), (66, 1), (90, 6), (400, 24), (3000, 150)):
            one = letters(n)
            two = one[: n // 3] + " " + one[n // 3 + 1 :]
            add(("letters", n), one, typos(one, edits))
            add(("two words", n), two, typos(two[: n // 3], edits // 2) + " " + typos(two[n // 3 + 1 :], edits - edits // 2))
        for n in (3, 5, 7):
            words = [letters(7 if n > 3 else 6) for _ in range(n)]
            changed = list(words)
            for at in rng.sample(range(n), 2):  # a letter in two words
                changed[at] = changed[at][:-1] + "z"
            add(("two of", n), " ".join(words), " ".join(changed))
        long = [letters(60) for _ in range(4)]
        add("long words", " ".join(long), " ".join(typos(w, 2) for w in long))
        words = [letters(6) for _ in range(100)]
        changed = [letters(6) if at % 10 == 5 else w for at, w in enumerate(words)]
        add("one word of ten", " ".join(words), " ".join(changed))
    group = line_groups(spark, docs)
    found = {kind: sum(group[normal(a)] == group[normal(b)] for a, b in some) / len(some) for kind, some in pairs.items()}
    assert all(found[kind] == 1 for kind in found if kind[1] in (3, 5, 7, 12, 14, 22)), found
    assert min(found.values()) >= 0.9, found


def test_reordered_lines_and_groups_of_near_copies_meet_leaders_only(spark, monkeypatch):
    """Orders of the same words share all blocks and are no near copies; checked pairs are counted."""
    rng = random.Random(4)
    words = [f"{c * 7}" for c in "abcdefghijkl"]
    orders = {" ".join(rng.sample(words, len(words))) for _ in range(40)}
    base = [f"n{rng.randrange(10**6)}" for _ in range(40)]
    near = {" ".join(base[:k] + [f"m{rng.randrange(10**6)}"] + base[k + 1 :]) for k in list(range(40)) * 8}
    checked = []
    whole = line_dedup._verified

    def counted(source, lines, pairs, similarity):
        checked.append(pairs.count())
        return whole(source, lines, pairs, similarity)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    group = line_groups(spark, list(enumerate([*near, *orders])))
    assert len({group[line] for line in near}) == 1 and sum(checked) <= 6 * len(near) + len(orders) ** 2
    assert all((group[a] == group[b]) >= alike(a, b) for a in orders for b in orders)


def test_links_of_members_that_have_a_leader(spark):
    """Chains of changes: a line that is a near copy of a leader links others that are not."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for _ in range(40):
        base = [word() for _ in range(40)]
        for step in range(0, 36, 6):  # neighbours differ in 6 of 40 words, others in 12 or more
            docs.append(" ".join([word() for _ in range(step)] + base[step:]) if step == 0 else " ".join(base))
            base[step : step + 6] = [word() for _ in range(6)]
    shuffled = list(enumerate(docs))
    group = line_groups(spark, shuffled)
    shared = lambda a, b: blocks[a] & blocks[b]
    frame = spark.createDataFrame(shuffled, "doc_id long, text string")
    blocks = {docs[r.doc_id]: set(r.blocks) for r in line_dedup.fingerprinted(line_dedup._source(frame, "doc_id", "text")).collect()}
    linked = [(a, b) for i, a in enumerate(docs) for b in docs[:i] if shared(a, b) and alike(a, b)]
    assert len(linked) > 100 and all(group[a] == group[b] for a, b in linked)


def test_edit_similarity_equals_the_plain_one(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(200):
        a = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))]
        b = list(a)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.choice(["a", "bb", "ca"])] * rng.randrange(2)
        pairs.append((a, b or ["a"]))
    rows = [(i, i, a, b) for i, (a, b) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "a long, b long, words_a array<string>, words_b array<string>")
    got = {r.a for r in line_dedup.edit_similar(frame).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = " ".join(a), " ".join(b)
        assert (i in got) == (edit_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9), (x, y)


def test_edit_similarity_of_long_lines_equals_the_plain_one(spark):
    """Changes before, after or all over the line, shifts of its start, and lines that share a part only."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8)))
    pairs = []
    for i in range(120):
        a = [word() for _ in range(rng.choice([30, 60, 90]))]
        part = int(len(a) * rng.choice([0.1, 0.18, 0.2, 0.22, 0.3, 0.6]))
        other = [word() for _ in range(part)]
        at = rng.randrange(len(a) - part)
        changed = a[:at] + other + a[at + part :]
        for spot in rng.sample(range(len(a)), part // 2):
            changed[spot] = word()
        b = [other + a[: len(a) - part], a[part:] + other, changed, other[: part // 2] + a, a[part // 2 :] + other][i % 5]
        pairs.append((a, b))
    rows = [(i, i, a, b) for i, (a, b) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "a long, b long, words_a array<string>, words_b array<string>")
    got = {r.a for r in line_dedup.edit_similar(frame).collect()}
    want = {i for i, (a, b) in enumerate(pairs) if alike(" ".join(a), " ".join(b))}
    assert got == want and 20 < len(want) < 100


def test_lines_of_odd_tables(spark):
    docs = odd_documents(spark)
    kept = line_dedup.drop_repeated_lines(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and len(rows) == len(odd_rows())
    texts = {r.doc_id: r.text for r in rows if r.doc_id not in (None, 7)}
    assert texts[2] is None and texts[3] == "" and texts[4] == "   \n\t \n" and texts[11] == "..."
    assert texts[1].startswith("The quick") and texts[8] == ""
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert sorted(r.text for r in rows if r.doc_id == 5) == [odd_rows()[4][1]] * 2  # a repeated row keeps what its twin keeps
    assert line_dedup.drop_repeated_lines(no_documents(spark)).count() == 0


# ---- passages


def plain_passages(docs: list[tuple[int, str | None]]) -> dict:
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone: set[int] = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        out[doc] = (len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def passage_documents() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    docs: list[tuple[int, str | None]] = [(900, None), (901, "")]
    for i in range(250):
        n = rng.choice([0, 5, 19, 20, 21, 60, 200])
        words = [rng.choice(["a", "b", "é"]) if rng.random() < 0.3 else f"x{rng.randrange(50)}" for _ in range(n)]
        if rng.random() < 0.5 and i:
            other = (rng.choice(docs[2:])[1] or "").split()
            at = rng.randrange(len(other) + 1)
            words[n // 2 : n // 2] = other[at : at + rng.randrange(60)]
        if i % 17 == 0:
            words = ["a"] * n
        docs.append((i, (" " if i % 3 else "\n\t").join(words)))
    return docs


@pytest.mark.parametrize("group_runs", [8192, 2])
def test_passages_equal_brute_force(spark, monkeypatch, group_runs):
    monkeypatch.setattr(substring_dedup, "GROUP_RUNS", group_runs)
    docs = passage_documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame).collect()}
    assert got == plain_passages(docs)


def test_passages_of_the_given_table_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, "/root/testdata/sf0.01", "documents").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_query(spark, "/root/testdata/sf0.01").collect()}
    assert got == plain_passages(docs)


def test_streams_do_not_depend_on_batches(spark):
    docs = spark.createDataFrame(passage_documents(), "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        found = []
        for rows in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            found.append(sorted(map(tuple, substring_dedup.remove_repeats(docs, with_text=False).collect())))
        assert found[0] == found[1] == found[2]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_passages_of_odd_tables(spark):
    rows = substring_dedup.remove_repeats(odd_documents(spark)).collect()
    assert len(rows) == len(odd_rows())
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[2].n_words, by_id[2].kept) == (0, "")
    assert [r.n_removed for r in rows if r.doc_id == 5] == [by_id[5].n_removed] * 2  # a repeated row does not repeat itself
    assert by_id[6].n_removed == 60_000 and by_id[6].kept == "end"
    assert substring_dedup.remove_repeats(no_documents(spark)).count() == 0


# ---- benchmark


def plain_leaks(docs, items) -> dict:
    words = lambda text: regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    grams = lambda w: [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    kept = {i: words(t) for i, t in items if words(t)}
    df: dict[str, int] = {}
    for w in kept.values():
        for g in set(grams(w)):
            df[g] = df.get(g, 0) + 1
    weight = lambda g: 1 + math.log((len(kept) + 1) / (df.get(g, 1) + 1))
    found = {}
    for doc, text in docs:
        w = words(text)
        for item, v in kept.items():
            want = set(grams(v))
            for at in range(max(1, len(w) - len(v) + 1)) if w else []:
                have = set(grams(w[at : at + len(v)]))
                score = sum(map(weight, want & have)) / sum(map(weight, want | have)) if want & have else 0
                if score >= 0.8:
                    found[doc, item] = max(found.get((doc, item), 0), round(score, 6))
    return found


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [f"t{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 20, 35, 60, 60, 200])]
    items += [(50, None), (51, "..."), (52, items[8][1]), (53, items[9][1] + " " + text(3))]
    docs = [(i, text(40)) for i in range(20)] + [(90, None), (91, ""), (92, items[9][1].upper()), (93, "t5")]
    for i in range(60):
        words = text(rng.randrange(30)).split()
        passage = (items[rng.randrange(12)][1] or "").split()
        for _ in range(rng.randrange(4)):
            passage[rng.randrange(len(passage))] = rng.choice(pool)
        docs.append((100 + i, ", ".join([*words, *passage, *text(rng.randrange(30)).split()])))
    frames = [spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.leaks(*frames).collect()}
    want = plain_leaks(docs, items)
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    missed = {k for k in want if k not in got and want[k] >= 0.9}
    assert not missed and len(got) >= 0.97 * len(want)  # fingerprints farther apart than the radius are rare even at 0.8


def test_leaks_of_the_given_table_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.decontaminate_query(spark, SF).collect()}
    assert got == plain_leaks(docs, items)


def test_leaks_of_odd_tables(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "lazy dog again and again today"), (1, "lazy dog again and again today"), (2, "x"), (None, "漢字")], "item_id long, text string")
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in odd_rows() if r[0] not in (1, 8, 9, 10))
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.leaks(no_documents(spark), items).count() == 0


def test_repeated_items_and_shared_shingles_have_their_true_weight(spark):
    rng = random.Random(12)
    word = lambda: f"q{rng.randrange(10**6)}"
    template = [word() for _ in range(12)]
    items = [(i, " ".join([word() for _ in range(60)])) for i in range(5)]
    # text of many items in a window's place of other words: it weighs less than words of no item
    items += [(10 + i, " ".join([*template, *[word() for _ in range(8)]])) for i in range(30)]
    docs = []
    for i in range(5):
        passage = items[i][1].split(" ")
        docs += [(10 * i + k, " ".join([*passage[:at], *template[: 60 - at]])) for k, at in enumerate(range(50, 58))]
        docs += [(1000 + 10 * i + k, " ".join([*passage[:at], *[word() for _ in range(60 - at)]])) for k, at in enumerate(range(50, 58))]
    want = plain_leaks(docs, items)
    repeated = items[:3] * 3 + items[3:]
    frames = [spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((docs, "doc_id"), (repeated, "item_id"))]
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.leaks(*frames).collect()}
    assert got == want and len(want) > 20


# ---- pipeline


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    counts = []
    docs = read_table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == read_table(spark, SF, "documents").columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2]
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(map(tuple, docs.collect()))
    assert len(corpus_pipeline.STAGES) in (4, 5) and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "same id, first text")], "item_id long, text string")
    for at, docs in enumerate((odd_documents(spark), no_documents(spark))):
        folder = write_tables(spark, f"{tmp_path}/{at}", documents=docs, labels=labels, benchmark=items)
        rows = corpus_pipeline.run(spark, folder).collect()
        assert len({(r.doc_id, r.ids_sha256) for r in rows}) == len(rows)
        assert set(CLASHES) & set(docs.columns) == (set() if at else set(CLASHES))


def test_later_rounds_search_only_groups_that_new_links_connect(spark, monkeypatch):
    """Lines that only two words join take several rounds; what the first one connected is not searched again."""
    copies = [f"w{i}a w{i}b w{i}c w{i}d w{i}e w{i}f w{i}g w{i}h w{i}i{end}" for i in range(30) for end in ("x", "y")]
    # one block of unlike lines, and in it near copies that neither share another block nor both lead
    unlike = [f"alpha beta {chr(97 + i) * 14}" for i in range(16)] + [f"alpha beta {chr(97 + i) * 13}z" for i in range(15)]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(copies + unlike)], "doc_id long, text string")
    sizes, components = [], line_dedup.components
    monkeypatch.setattr(line_dedup, "components", lambda edges, a, b: sizes.append(edges.count()) or components(edges, a, b))
    source = line_dedup._source(docs, "doc_id", "text")
    lines = line_dedup.written(line_dedup.fingerprinted(source), "lines")
    links = line_dedup.similar_lines(source, lines)
    assert len(sizes) > 1 and sizes[0] >= 30 and sum(sizes[1:]) <= 2 * 15
    groups = {r.node: r.component for r in components(links, "node", "lead").collect()}
    node = {r.doc_id: r.k1 for r in lines.collect()}
    at = len(copies)
    assert all(groups[node[2 * i]] == groups[node[2 * i + 1]] for i in range(30))
    assert all(groups[node[at + i]] == groups[node[at + 16 + i]] for i in range(15))
    assert len(set(groups.values())) == 45
