"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its character n-grams (one to three letters, words bounded by a blank),
hashed into a fixed number of buckets; a linear softmax over languages follows. Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents. Scores are calibrated by one temperature, fitted on
a part of the sample that the training did not see, and a prediction whose calibrated score is below the threshold that
keeps the wanted precision there is marked as rejected.

The sample: a hash of the text orders the different labelled texts, and each language gives an equal share of
``max_rows``; copies of a text count once. Of a sampled text the n-grams at up to ``max_grams`` evenly spread places are used. Predictions use all n-grams
of the whole text. At prediction the average of embeddings times the softmax weights is the average of their product,
so one small table (buckets x languages) goes to the tasks.

Nulls and edge cases: a text that is null or has no letter is ``und`` with score 0. Rows without language or text are
no training rows. Without any training row every document is ``und``. A language of one row is learned like others.
Repeated rows
and copies change nothing in training. Very long texts are worked through in pieces. Columns beside id, text and language are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trustframe.llm.common import map_slices, read_table

BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
WIDTH = 16
EPOCHS = 4
RATE = 0.1
MAX_ROWS = 6000  # labelled rows of the sample, all languages together
MAX_LABELS = 1000  # languages that are learned: those of the most different texts
MAX_GRAMS = 1500  # n-grams of each order used from a sampled text
CALIBRATION = 5  # every fifth sampled row calibrates and does not train
PRECISION = 0.99
FOLDS = 5
UNKNOWN = "und"
PIECE = 1 << 20  # letters of a text that are scored at once


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its own number if it is a letter, else the blank."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for code in range(0x110000):
        if chr(code).isalpha():
            table[code] = code
    return table


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lowered text, non-letters as single blanks, one blank at each end; empty without letters."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    blank = codes == 32
    keep = ~(blank & np.r_[False, blank[:-1]])
    codes = codes[keep]
    return codes if len(codes) > 1 else codes[:0]


def gram_buckets(codes: np.ndarray, order: int, buckets: int = BUCKETS) -> np.ndarray:
    """Hash bucket of each run of ``order`` code points."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    mixed = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for i in range(order):
        mixed = (mixed ^ codes[i : i + n]) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0xC2B2AE35)
    return ((mixed >> np.uint32(8)) % np.uint32(buckets)).astype(np.int64)


def _spread(values: np.ndarray, most: int) -> np.ndarray:
    return values if len(values) <= most else values[np.linspace(0, len(values) - 1, most).astype(np.int64)]


@dataclass(frozen=True)
class LanguageModel:
    """``table`` is buckets x languages: embedding times softmax weights; ``bias`` the intercepts."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, codes: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for start in range(0, len(codes), PIECE):
            for order in GRAMS:
                found = gram_buckets(codes[start : start + PIECE + order - 1], order)
                total += [column[found].sum() for column in self.table.T]
                n += len(found)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score and whether the score clears the rejection threshold."""
        codes = letter_codes(text or "")
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0, False
        scores = _softmax(self.logits(codes)[None, :] / self.temperature)[0]
        best = int(scores.argmax())
        return self.languages[best], float(scores[best]), bool(scores[best] >= self.threshold)


def _softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def train_sgd(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings x softmax weights and bias from ``(buckets, shares, class)`` rows, by plain stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(scale=1.0 / WIDTH, size=(BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, classes)), np.zeros(classes)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for at in rng.permutation(len(rows)):
            found, share, label = rows[at]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share @ embed[found]
            off = _softmax((hidden @ weights + bias)[None, :])[0]
            off[label] -= 1.0
            back = weights @ off
            weights -= rate * np.outer(hidden, off)
            bias -= rate * off
            embed[found] -= (rate * len(found)) * np.outer(share, back)  # the share of a gram is small; scaled to its row
    return embed @ weights, bias


def calibrate(logits: np.ndarray, labels: np.ndarray, precision: float = PRECISION) -> tuple[float, float]:
    """Temperature of least log loss, and the least score from which on ``precision`` of the predictions are right."""
    if not len(labels):
        return 1.0, 0.0
    grid = np.geomspace(0.5, 5.0, 40)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    scores = _softmax(logits / temperature)
    top, right = scores.max(axis=1), scores.argmax(axis=1) == labels
    order = np.argsort(-top, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(labels) + 1))
    return temperature, float(top[order][good[-1]]) if len(good) else 1.0


def sample_rows(labelled: DataFrame, text_col: str, label: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(text, label, _order)``: about ``max_rows`` texts with an equal share for each label, chosen by a hash.

    Copies of a text with one label count once, so they neither thin out the others of the label nor fill the sample.
    Shares are met by a threshold on the hash computed from counts, so no label's rows are sorted in one task; each
    label has its own bound of twice its share. The ``MAX_LABELS`` labels of the most texts are learned.
    """
    rows = labelled.select(F.col(text_col).alias("text"), label.alias("label")).where(F.col("text").isNotNull() & F.col("label").isNotNull())
    rows = rows.withColumn("_order", F.xxhash64("text", F.lit("sample")))
    different = rows.select("label", "_order").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["label"]: r["n"] for r in different.orderBy(F.col("n").desc(), "label").limit(MAX_LABELS).collect()}
    share = max(1, max_rows // max(1, len(counts)))
    kept = F.lit(False)
    for value, n in counts.items():
        low = (F.col("_order").cast("double") / F.lit(2.0**64) + 0.5) < F.lit(min(1.0, share / n))
        kept = kept | ((F.col("label") == F.lit(value)) & low)
    once = rows.where(kept).dropDuplicates(["label", "_order"])
    first = Window.partitionBy("label").orderBy("_order")
    return once.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= 2 * share).drop("_place")


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", max_rows: int = MAX_ROWS) -> LanguageModel:
    """Train on a bounded sample of the rows with a language; see the head of this module."""
    sampled = sample_rows(labelled, text_col, F.col(label_col), max_rows)

    def grams(part: pa.RecordBatch) -> dict:
        columns: dict = {"label": [], "found": [], "share": [], "place": []}
        for text, label, place in zip(*(part.column(i).to_pylist() for i in range(3))):
            codes = letter_codes(text)
            if len(codes):
                found = np.concatenate([_spread(gram_buckets(codes, order), MAX_GRAMS) for order in GRAMS])
                buckets, n = np.unique(found, return_counts=True)
                columns["label"].append(label)
                columns["found"].append(buckets.tolist())
                columns["share"].append((n / n.sum()).tolist())
                columns["place"].append(place)
        return columns

    schema = "label string, found array<int>, share array<double>, place long"
    collected = map_slices(sampled, grams, schema).toArrow()
    labels = collected["label"].to_pylist()
    order = np.lexsort((np.unique(labels, return_inverse=True)[1] if labels else [], collected["place"].to_numpy()))
    languages = tuple(sorted(set(labels)))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    found, share = collected["found"], collected["share"]
    rows = [(found[i].values.to_numpy(), share[i].values.to_numpy(), languages.index(labels[i])) for i in order.tolist()]
    held = rows[::CALIBRATION] if len(rows) >= 10 * CALIBRATION else []
    train = [row for i, row in enumerate(rows) if i % CALIBRATION] if held else rows
    table, bias = train_sgd(train, len(languages))
    logits = np.array([share @ table[found] + bias for found, share, _ in held]).reshape(len(held), len(languages))
    temperature, threshold = calibrate(logits, np.array([label for *_, label in held], dtype=np.int64))
    return LanguageModel(languages, table, bias, temperature, threshold)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, accepted)`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the corpus
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(part: pa.RecordBatch) -> dict:
        found = [shared.value.predict(text) for text in part.column(1).to_pylist()]
        lang, score, accepted = zip(*found)
        return {"doc_id": part.column(0), "lang_pred": lang, "score": score, "accepted": accepted}

    return map_slices(rows, run, "doc_id long, lang_pred string, score double, accepted boolean")


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text, modulo ``folds``, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def language_query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
