"""Toxicity scores by weak supervision: many voters, a generative label model, and a linear classifier.

Voters are words of a fixed lexicon, patterns, and word stems (a word, or its first three to eight letters) that the
labelled documents of the learning part point to. The label model treats the true class as hidden: each voter fires
with one rate on toxic and another on clean documents, the given label is a voter that may be wrong, and voters whose
firings stay correlated within a class share their weight. Expectation maximisation estimates rates, label accuracy,
correlations and the posterior of each document. A logistic regression on vote features learns the posteriors; it
alone scores.

All documents of the sample vote on Spark; only counts of stems (the best ``MAX_STEMS``) and the sparse votes of at
most ``max_rows`` labelled documents come to the driver. Every document is scored, whole text, in one pass.

Nulls and edge cases: a null text reads as empty and, like a text without letters, casts no votes but still gets a
score. Labels that are null, or of no document, teach nothing; a document labelled twice counts twice. Without labels of
both classes the lexicon alone decides. Ties are broken by the stem; repeated rows change nothing. An empty table gives
an empty result. Columns beside id and text pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from trustframe.llm.common import column_of, map_slices, read_table, whole_rows
from trustframe.llm.language_id import held_out

# Common insults of four languages.
LEXICON = tuple(
    "idiot moron stupid dumb fool loser clown trash scum worthless pathetic disgusting ugly filthy vermin imbecile "
    "trottel dummkopf blödmann abschaum wertlos erbärmlich widerlich versager "
    "crétin imbécile ordure minable dégoûtant débile abruti "
    "idiota estúpido imbécil basura inútil patético asqueroso escoria".split()
)
# Patterns; each is a set of strings of which one must occur.
PATTERNS = {
    "shout": ("!!",),
    "address": ("you are", "you're", "du bist", "tu es", "eres"),
    "grawlix": ("@#", "#@", "$#", "#!", "***", "###", "$$$", "%%%", "&&&"),
}
LETTERS = re.compile(r"[^\W\d_]+")
STEM = range(3, 9)
MAX_ROWS = 20_000  # labelled documents that the model is fitted on
TOXIC_SHARE = 0.3  # of them, at most so many toxic ones
MAX_STEMS = 3000  # stems that reach the driver, best first
MAX_VOTERS = 200
LEAST_SUPPORT = 3
LEAST_ODDS = np.log(8.0)
EM_ROUNDS = 25
RIDGE = 0.5
REMEMBERED = 400_000


def stems(word: str) -> list[str]:
    """The whole word (``=word``) and its leading letters (``word*``)."""
    return ["=" + word, *[word[:n] + "*" for n in STEM if n <= len(word)]]


class Matcher(dict):
    """Word -> numbers of the stem voters it fires; words are remembered as they come."""

    def __init__(self, keys: tuple[str, ...]):
        super().__init__()
        self.number = {key: i for i, key in enumerate(keys)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        found = tuple(self.number[key] for key in stems(word) if key in self.number)
        self[word] = found
        return found


def votes(text: str | None, matcher: Matcher) -> tuple[dict[int, int], int, list[int], int]:
    """Counts by stem voter, number of hit words, patterns that fire, number of words."""
    text = text or ""
    words = LETTERS.findall(text.lower())
    counts: dict[int, int] = {}
    hits = 0
    for found in filter(None, map(matcher.__getitem__, words)):
        hits += 1
        for voter in found:
            counts[voter] = counts.get(voter, 0) + 1
    lowered = text.lower()
    fired = [i for i, strings in enumerate(PATTERNS.values()) if any(s in lowered for s in strings)]
    return counts, hits, fired, len(words)


@dataclass
class LabelModel:
    """Firing rates on toxic and clean documents, weights for correlated voters, class share, label accuracies."""

    toxic_rate: np.ndarray
    clean_rate: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray
    share: float
    label_rates: tuple[float, float] = field(default=(0.9, 0.1))  # P(label 1) on toxic and on clean documents

    def posterior(self, fires: np.ndarray, labels: np.ndarray) -> np.ndarray:
        on = np.log(self.toxic_rate / self.clean_rate)
        off = np.log((1 - self.toxic_rate) / (1 - self.clean_rate))
        logit = np.log(self.share / (1 - self.share)) + fires @ (self.weight * on) + (1 - fires) @ (self.weight * off)
        hit, false = self.label_rates
        logit += np.where(labels == 1, np.log(hit / false), np.log((1 - hit) / (1 - false)))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit_label_model(fires: np.ndarray, labels: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation from the given labels; returns the model and the posterior of each row.

    Correlations are those of the votes around their class rates. A voter's weight is one over the sum of its positive
    correlations with all voters, so a group of copies of one voter together counts about once.
    """
    posterior = np.where(labels == 1, 0.9, 0.1)
    model = None
    for _ in range(rounds):
        toxic, clean = posterior.sum(), (1 - posterior).sum()
        p1 = (posterior @ fires + 0.5) / (toxic + 1)
        p0 = ((1 - posterior) @ fires + 0.5) / (clean + 1)
        off = fires - (posterior[:, None] * p1 + (1 - posterior)[:, None] * p0)
        covariance = off.T @ off / len(fires)
        deviation = np.sqrt(np.diag(covariance)) + 1e-6
        correlation = covariance / np.outer(deviation, deviation)
        weight = 1 / np.maximum(1.0, np.where(correlation > 0.1, correlation, 0).sum(axis=1))
        hit = (posterior[labels == 1].sum() + 8) / (toxic + 10)
        false = ((1 - posterior)[labels == 1].sum() + 1) / (clean + 20)
        share = float(np.clip(posterior.mean(), 0.01, 0.99))
        model = LabelModel(p1, p0, weight, correlation, share, (float(hit), float(false)))
        new = model.posterior(fires, labels)
        moved = np.abs(new - posterior).max()
        posterior = new
        if moved < 1e-4:
            break
    assert model is not None
    return model, posterior


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression on soft labels by damped Newton steps; the first weight is the intercept."""
    x = np.c_[np.ones(len(x)), x]
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty * beta
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        beta += step
        if np.abs(step).max() < 1e-5:
            break
    return beta


@dataclass(frozen=True)
class ToxicityModel:
    keys: tuple[str, ...]
    beta: np.ndarray
    lexicon: frozenset[int]

    def features(self, counts: dict[int, int], hits: int, fired: list[int], words: int) -> np.ndarray:
        """Votes, patterns, and how often and how densely stems and lexicon words occur."""
        x = np.zeros(feature_count(len(self.keys)))
        m = len(self.keys)
        for voter in counts:
            x[voter] = 1.0
        for pattern in fired:
            x[m + pattern] = 1.0
        listed = sum(n for voter, n in counts.items() if voter in self.lexicon)
        x[-4:] = np.log1p(hits), np.sqrt(100.0 * hits / max(1, words)), np.log1p(listed), np.log1p(words) / 5.0
        return x

    def score(self, text: str | None, matcher: Matcher) -> float:
        counts, hits, fired, words = votes(text, matcher)
        z = float(self.beta[0] + self.beta[1:] @ self.features(counts, hits, fired, words))
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def feature_count(voters: int) -> int:
    return voters + len(PATTERNS) + 4


def sample_labels(labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """``(doc_id, toxic)`` of at most ``max_rows`` labels, chosen by a hash of the id, and the share kept of each class."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {1: int(max_rows * TOXIC_SHARE), 0: int(max_rows * (1 - TOXIC_SHARE))}
    shares = {c: min(1.0, wanted[c] / max(1, sizes.get(c, 0))) for c in (0, 1)}
    place = F.xxhash64("doc_id", F.lit("toxicity")).cast("double") / F.lit(2.0**64) + 0.5
    kept = rows.where(place < F.when(F.col("toxic") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0])))
    return kept.orderBy(place, "doc_id", "toxic").limit(max_rows + max_rows // 10), shares


def find_stems(sampled: DataFrame) -> list[tuple[str, int, int]]:
    """``(stem, toxic documents, clean documents)`` of the ``MAX_STEMS`` stems that most favour toxic documents."""

    def count(part: pa.RecordBatch) -> dict:
        tally: dict[str, list[int]] = {}
        for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            for key in {key for word in set(LETTERS.findall((text or "").lower())) for key in stems(word)}:
                tally.setdefault(key, [0, 0])[toxic] += 1
        return {"stem": list(tally), "clean": [n[0] for n in tally.values()], "toxic": [n[1] for n in tally.values()]}

    counted = map_slices(sampled.select("text", "toxic"), count, "stem string, clean long, toxic long")
    totals = counted.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    usual = totals.where(F.col("toxic") >= LEAST_SUPPORT).withColumn("gain", F.col("toxic") * ratio).where(ratio > 0)
    best = usual.orderBy(F.col("gain").desc(), F.length("stem").desc(), "stem").limit(MAX_STEMS)
    return [(r["stem"], r["toxic"], r["clean"]) for r in best.collect()]


def collect_votes(sampled: DataFrame, keys: tuple[str, ...]) -> list[dict]:
    """Sparse votes of the sample's documents, a bounded number of rows with at most one entry for each voter."""
    model_keys = keys

    def vote(part: pa.RecordBatch) -> dict:
        matcher = Matcher(model_keys)
        rows = [votes(text, matcher) for text in part.column(0).to_pylist()]
        return {
            "toxic": part.column(1),
            "voters": [list(counts) for counts, *_ in rows],
            "counts": [list(counts.values()) for counts, *_ in rows],
            "hits": [r[1] for r in rows], "fired": [r[2] for r in rows], "words": [r[3] for r in rows],
        }

    schema = "toxic int, voters array<int>, counts array<int>, hits int, fired array<int>, words int"
    return map_slices(sampled.select("text", "toxic"), vote, schema).toArrow().to_pylist()


def choose_voters(found: list[tuple[str, int, int]], rows: list[dict]) -> list[int]:
    """Greedy cover: stems in order of gain, each with toxic documents that those before it do not reach."""
    toxic = [i for i, row in enumerate(rows) if row["toxic"] == 1]
    place = {row: i for i, row in enumerate(toxic)}
    members: dict[int, list[int]] = {}
    for i in toxic:
        for voter in rows[i]["voters"]:
            members.setdefault(voter, []).append(place[i])
    covered = np.zeros(len(toxic), dtype=np.int32)
    n1, n0 = max(1, len(toxic)), max(1, len(rows) - len(toxic))
    chosen = []
    for voter, (_, hit, miss) in enumerate(found):
        odds = np.log((hit + 0.5) / (n1 + 1)) - np.log((miss + 0.5) / (n0 + 1))
        reach = np.array(members.get(voter, []), dtype=np.int64)
        if odds >= LEAST_ODDS and len(reach) and (covered[reach] < 2).sum() >= LEAST_SUPPORT:
            chosen.append(voter)
            covered[reach] += 1
        if len(chosen) == MAX_VOTERS:
            break
    return chosen


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Fit on the labelled rows of ``docs`` (``doc_id``, ``text``).

    The caller keeps what is to be held out back from both tables: classes are counted over all ``labels`` given.
    """
    chosen, shares = sample_labels(labels, max_rows)
    sampled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = find_stems(sampled)
    listed = [f"={word}" for word in LEXICON]
    stems_found = [row for row in found if row[0] not in set(listed)]
    keys = (*[row[0] for row in stems_found], *listed)
    rows = collect_votes(sampled, keys)
    if not {row["toxic"] for row in rows} >= {0, 1}:
        model = ToxicityModel(tuple(listed), np.zeros(1 + feature_count(len(listed))), frozenset(range(len(listed))))
        model.beta[0], model.beta[-2] = -2.0, 4.0
        return model
    kept = choose_voters(stems_found, rows) + list(range(len(stems_found), len(keys)))
    lexicon = frozenset(i for i, voter in enumerate(kept) if voter >= len(stems_found))
    blank = ToxicityModel(tuple(keys[voter] for voter in kept), np.zeros(0), lexicon)
    rows = collect_votes(sampled, blank.keys)  # by the chosen voters alone, as when scoring
    features = np.zeros((len(rows), feature_count(len(kept))))
    for i, row in enumerate(rows):
        features[i] = blank.features(dict(zip(row["voters"], row["counts"])), row["hits"], row["fired"], row["words"])
    labels_given = np.array([row["toxic"] for row in rows])
    _, posterior = fit_label_model(features[:, : len(kept) + len(PATTERNS)], labels_given)
    weight = np.where(labels_given == 1, 1 / shares[1], 1 / shares[0])
    beta = fit_logistic(features, posterior, weight / weight.mean())
    return ToxicityModel(blank.keys, beta, lexicon)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Each row as a struct ``row`` with its ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred stems and weights, whatever the corpus
    rows = whole_rows(docs)  # the text goes to the tasks once, inside its row
    schema = T.StructType([
        T.StructField("row", docs.schema), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())
    ])

    def run(part: pa.RecordBatch) -> dict:
        matcher = Matcher(shared.value.keys)
        scores = [shared.value.score(text, matcher) for text in column_of(part, "row.text").to_pylist()]
        return {"row": part.column(0), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return map_slices(rows, run, schema, "row.text")


def learn(spark, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """Fit on the documents and labels that are not held out."""
    return fit(docs.where(~held_out()), read_table(spark, sf_dir, "labels").where(~held_out()))


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), learn(spark, docs, sf_dir))
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", "predicted")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    return score(docs, learn(spark, docs, sf_dir)).where(F.col("predicted") == 0).select("row.*")
