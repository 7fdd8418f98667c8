"""Removal of repeated passages: sparse suffix trees in groups by prefixes of variable length.

A window is ``WINDOW`` consecutive words of a document. Words covered by a window whose words also start earlier (at a
smaller document id, or earlier in the document) are removed; windows are judged on the input.

Suffixes are indexed sparsely. Every window names one anchor, the run of ``PREFIX`` words in it whose hash is smallest
(the first of equal ones), so equal windows name equal anchors at equal places. Neighbouring windows with the same
anchor form a run of suffixes, about seven windows each, and the anchor is the prefix by which suffixes are grouped:

1. One scan makes the runs. Runs of equal words within a slice of the scan meet there already: only the earliest goes
   on, the others are repeats.
2. Runs are grouped by their prefix and stream by in order. Equal runs are repeats of the first; a prefix with one
   distinct run cannot repeat elsewhere and is dropped.
3. What is left, the first of each distinct run under a shared prefix, gets its words. Groups of up to ``GROUP_RUNS``
   runs are sorted into a suffix tree cut at ``WINDOW`` words (a sorted array of suffixes with the lengths of common
   prefixes); its internal nodes at that depth are the repeats, and all leaves but the earliest are marked. A
   larger group gets a longer prefix, all words of the window, where a node needs no tree: the earliest of equal
   windows is a plain aggregate.

No group is held whole unless it is below ``GROUP_RUNS``; the stream of step 2 keeps one row. Words are compared by 64
bit hashes, runs by two of them.

Nulls and edge cases: a null text has no words; fewer than ``WINDOW`` words make no window. A null id comes before all
others. Rows of one id count as one document: windows at the same start are ordered by a hash of the text, and a
repeated row (same id and text) does not repeat itself. Very long texts are worked on whole. An empty table gives an
empty result. Columns beside id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trustframe.llm.common import map_slices, read_table, sized, written

WINDOW = 20
PREFIX = 6
GROUP_RUNS = 8192
REMEMBERED = 300_000
NO_ID = -(1 << 63)  # stands for a null id, before all others
# A place packs the first word of a run (30 bits), a hash of the text (29) and the number of its windows (4).
START, TEXT = 33, 4


class WordHashes(dict):
    """Word -> 64 bit hash, remembered as words come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8").split()  # of bytes: splits at ASCII white space only
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def prefix_hashes(words: np.ndarray, length: int = PREFIX) -> np.ndarray:
    """Hash of each run of ``length`` words."""
    n = len(words) - length + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        mixed = (mixed ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def runs_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor hash, first window, number of windows)`` of each run of windows with one anchor."""
    prefixes = prefix_hashes(words)
    wide = np.lib.stride_tricks.sliding_window_view(prefixes, WINDOW - PREFIX + 1)
    anchor = wide.argmin(axis=1) + np.arange(len(wide))
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return prefixes[anchor[first]], first, np.diff(np.r_[first, len(anchor)])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, h, text)``: id with ``NO_ID`` for null, and 29 bits of the text's hash. None is ever null."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text_col).bitwiseAND(F.lit((1 << 29) - 1)).alias("h"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def find_runs(source: DataFrame) -> DataFrame:
    """``(anchor, run, doc, place, again)``; ``again`` marks runs with an earlier equal run in the same slice."""

    def scan(part: pa.RecordBatch) -> dict | None:
        docs, marks = part.column(0).to_pylist(), part.column(1).to_pylist()
        found = []
        for doc, mark, text in zip(docs, marks, part.column(2).to_pylist()):
            words = word_hashes(text)
            if len(words) >= WINDOW:
                anchor, first, n = runs_of(words)
                raw = words.tobytes()
                digest = xxhash.xxh3_64_intdigest
                run = [digest(raw[8 * s : 8 * (s + m + WINDOW - 1)]) for s, m in zip(first.tolist(), n.tolist())]
                place = (first.astype(np.int64) << START) | (mark << TEXT) | n
                found.append((anchor, np.array(run, dtype=np.uint64), np.full(len(n), doc, dtype=np.int64), place))
        if not found:
            return None
        anchor, run, doc, place = (np.concatenate(columns) for columns in zip(*found))
        order = np.lexsort((place, doc, run, anchor))
        anchor, run, doc, place = anchor[order], run[order], doc[order], place[order]
        again = np.r_[False, (anchor[1:] == anchor[:-1]) & (run[1:] == run[:-1])]
        itself = again & np.r_[False, (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])]
        columns = {"anchor": anchor.view(np.int64), "run": run.view(np.int64), "doc": doc, "place": place, "again": again}
        return {name: values[~itself] for name, values in columns.items()}

    return map_slices(source, scan, "anchor long, run long, doc long, place long, again boolean")


def _stream_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor, run, doc, place: repeats of the row before, and first runs of shared anchors.

    Between batches only the last row is kept, and whether it still waits for a second run of its anchor.
    """
    last: tuple[int, int, int, int] | None = None
    waiting: tuple[int, int, int] | None = None  # anchor, doc and place of a first run that is alone so far
    for batch in batches:
        anchor, run, doc, place = (batch.column(i).to_numpy() for i in range(4))
        if not len(anchor):
            continue
        before = last or (0, 0, 0, 0)
        new_anchor = np.r_[last is None or anchor[0] != before[0], anchor[1:] != anchor[:-1]]
        new_run = new_anchor | np.r_[last is None or run[0] != before[1], run[1:] != run[:-1]]
        itself = ~new_run & np.r_[
            last is not None and (doc[0], place[0]) == before[2:], (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
        ]
        repeat = ~new_run & ~itself
        first = np.flatnonzero(new_run)
        shared_before = ~new_anchor[first]
        shared_after = np.r_[~new_anchor[first[1:]], False] if len(first) else shared_before
        keep = first[shared_before | shared_after]
        out = [(anchor[repeat], doc[repeat], place[repeat], True), (anchor[keep], doc[keep], place[keep], False)]
        if len(first):
            if waiting is not None and shared_before[0]:
                out.append(tuple(np.array([v]) for v in waiting) + (False,))
            alone = first[-1]
            waiting = None if shared_before[-1] else (int(anchor[alone]), int(doc[alone]), int(place[alone]))
        last = (int(anchor[-1]), int(run[-1]), int(doc[-1]), int(place[-1]))
        for a, d, p, again in out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(d, pa.int64()), pa.array(p, pa.int64()), pa.array(np.full(len(a), again))],
                names=["anchor", "doc", "place", "again"],
            )


def _by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of one document as an array; they are no more than its windows."""
    mark = F.shiftright("place", TEXT).bitwiseAND(F.lit((1 << 29) - 1))
    return rows.withColumn("h", mark).groupBy("doc", "h").agg(F.collect_list(F.struct("place", *columns)).alias("rows"))


def _windows(source: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(anchor, large, doc, place, words, equal)``: suffix rows of small groups with their words, windows of large ones.

    A large group's rows hold one window each, and ``equal`` is a second hash of its words under which they meet.
    """

    def cut(part: pa.RecordBatch) -> dict:
        columns: dict = {name: [] for name in ("anchor", "large", "doc", "place", "words", "equal")}
        for doc, text, rows in zip(*(part.column(i).to_pylist() for i in range(3))):
            raw = word_hashes(text).tobytes()
            for row in rows:
                place = row["place"]
                start, n = place >> START, place & 15
                if row["large"]:
                    for s in range(start, start + n):
                        window = raw[8 * s : 8 * (s + WINDOW)]
                        made = (
                            xxhash.xxh3_64_intdigest(window, 1), True, doc, (s << START) | (place & ((1 << START) - 16)) | 1,
                            None, xxhash.xxh3_64_intdigest(window, 2),
                        )
                        for name, value in zip(columns, made):
                            columns[name].append(value - (1 << 64) if name in ("anchor", "equal") and value >> 63 else value)
                else:
                    made = (row["anchor"], False, doc, place, raw[8 * start : 8 * (start + n + WINDOW - 1)], 0)
                    for name, value in zip(columns, made):
                        columns[name].append(value)
        return columns

    met = source.join(_by_document(firsts, "anchor", "large").hint("merge"), ["doc", "h"]).select("doc", "text", "rows")
    return map_slices(met, cut, "anchor long, large boolean, doc long, place long, words binary, equal long")


def tree_repeats(anchor: np.ndarray, doc: np.ndarray, place: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, place)`` of single windows that a suffix tree of the given runs shows to start earlier, too.

    Suffixes cut at ``WINDOW`` words are sorted under their anchor; neighbours with a common prefix of all words lie in
    one node of the tree, and a node's leaves but the earliest are repeats.
    """
    counts = (place & 15).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = np.frombuffer(b"".join(words), dtype=np.uint64)
    base = np.cumsum(counts + WINDOW - 1) - (counts + WINDOW - 1)
    suffixes = flat[(base[owner] + inside)[:, None] + np.arange(WINDOW)]
    keyed = np.column_stack([anchor[owner].view(np.uint64), suffixes]).astype(">u8")
    start = (place[owner] >> START) + inside
    at = (start << START) | (place[owner] & ((1 << START) - 16)) | 1
    leaf = np.ascontiguousarray(keyed).view(f"V{8 * (WINDOW + 1)}").ravel()
    order = np.argsort(leaf, kind="stable")
    depth = (keyed[order[1:]] == keyed[order[:-1]]).all(axis=1)  # common prefix of all words
    node = np.cumsum(np.r_[True, ~depth]) - 1
    by_age = np.lexsort((at[order], doc[owner][order], node))
    earliest = np.r_[True, node[by_age][1:] != node[by_age][:-1]]
    later = order[by_age[~earliest]]
    return doc[owner][later], at[later]


def _stream_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of whole groups; rows come in order of anchor, and a group that a batch cuts waits for the next."""
    held: list[pa.RecordBatch] = []

    def grow(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        if table.num_rows:
            doc, place = tree_repeats(*(table.column(c).to_numpy() for c in ("anchor", "doc", "place")), table.column("words").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int64())], names=["doc", "place"])

    for whole in batches:
        for lo in range(0, whole.num_rows, 4096):
            batch = whole.slice(lo, 4096)
            anchor = batch.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
            if cut or (held and held[-1].column("anchor")[-1].as_py() != anchor[0]):
                yield from grow([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
    if held:
        yield from grow(held)


def repeated_places(source: DataFrame) -> DataFrame:
    """``(doc, place)`` of all runs and windows that start earlier, too; the low bits of ``place`` tell how many windows."""
    runs = written(find_runs(source), "runs")
    ordered = (
        runs.where(~F.col("again")).select("anchor", "run", "doc", "place").repartition("anchor")
        .sortWithinPartitions("anchor", "run", "doc", "place")
    )
    marks = written(ordered.mapInArrow(_stream_marks, "anchor long, doc long, place long, again boolean"), "marks")
    firsts = marks.where(~F.col("again"))
    sizes = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_RUNS)
    large = sized(written(sizes.select("anchor", F.lit(True).alias("_large")), "large"))
    sorted_out = firsts.join(large, "anchor", "left").select("anchor", "doc", "place", F.coalesce("_large", F.lit(False)).alias("large"))
    suffixes = written(_windows(source, sorted_out), "suffixes")
    small = suffixes.where(~F.col("large")).select("anchor", "doc", "place", "words").repartition("anchor").sortWithinPartitions("anchor")
    from_trees = small.mapInArrow(_stream_trees, "doc long, place long")
    windows = suffixes.where("large").select("anchor", "equal", "doc", "place")
    earliest = windows.groupBy("anchor", "equal").agg(F.min(F.struct("doc", "place")).alias("_first"))
    from_windows = windows.join(earliest, ["anchor", "equal"]).where(F.struct("doc", "place") != F.col("_first")).select("doc", "place")
    repeats = runs.where("again").select("doc", "place").unionByName(marks.where("again").select("doc", "place"))
    return repeats.unionByName(from_trees).unionByName(from_windows)


def remove_repeats(docs: DataFrame, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept])`` of each row; ``kept`` joins the kept words by one space."""
    source = _source(docs, id_col, text_col)
    spans = _by_document(repeated_places(source)).select("doc", "h", F.col("rows.place").alias("places"))
    met = source.join(spans.hint("merge"), ["doc", "h"], "left").select("doc", "text", "places")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]

    def cut(part: pa.RecordBatch) -> dict:
        columns: dict = {name: [] for name in names}
        for doc, text, places in zip(*(part.column(i).to_pylist() for i in range(3))):
            words = text.encode("utf-8").split()
            kept = words
            if places:
                place = np.array(places, dtype=np.int64)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, place >> START, 1)
                np.add.at(edge, (place >> START) + (place & 15) + WINDOW - 1, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            joined = b" ".join(kept)
            made = (None if doc == NO_ID else doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest())
            for name, value in zip(names, (*made, joined.decode("utf-8") if with_text else None)):
                columns[name].append(value)
        return columns

    out = map_slices(met, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")


def substring_query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False)
