"""Trained operators: held-out quality on the given tables, the parts of the models, and odd tables."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from llm_tables import CLASHES, no_documents, odd_documents, odd_rows, write_tables

from trustframe.llm import common, language_id, toxicity
from trustframe.llm.common import read_table

SF = "/root/testdata/sf0.1"


def test_language_accuracy_on_held_out_documents(spark):
    rows = language_id.language_query(spark, SF).join(read_table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    accepted = [r for r in held if r.accepted]
    assert len(accepted) > 0.9 * len(held) and np.mean([r.lang == r.lang_pred for r in accepted]) > 0.99


def test_language_of_odd_documents(spark):
    docs = odd_documents(spark)
    found = language_id.predict(docs, language_id.fit(docs)).collect()
    assert len(found) == len(odd_rows())
    by_id = {r.doc_id: r for r in found}
    for doc in (2, 3, 4, 11):  # null, empty, white space, marks only
        assert (by_id[doc].lang_pred, by_id[doc].score, by_id[doc].accepted) == ("und", 0.0, False)
    assert by_id[9].lang_pred == "en"  # the only language
    nothing = language_id.fit(no_documents(spark))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(no_documents(spark), nothing).count() == 0


def test_language_fit_is_repeatable_and_separates():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(500 * c, 500 * c + 600, 80)), None, c) for c in (0, 1, 2) for _ in range(60)]
    rows = [(found, np.full(len(found), 1 / len(found)), c) for found, _, c in rows]
    table, bias = language_id.train_sgd(rows, 3)
    again, _ = language_id.train_sgd(rows, 3)
    assert np.array_equal(table, again)
    assert np.mean([(share @ table[found] + bias).argmax() == c for found, share, c in rows]) > 0.95


def test_calibration_keeps_the_wanted_precision():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 2000)
    logits = rng.normal(size=(2000, 3)) + 3 * np.eye(3)[labels]
    temperature, threshold = language_id.calibrate(logits * 4, labels, 0.99)
    scores = np.exp(logits * 4 / temperature)
    scores /= scores.sum(axis=1, keepdims=True)
    kept = scores.max(axis=1) >= threshold
    assert 1.2 < temperature < 1.7 and kept.any()  # four thirds makes these logits true
    assert (scores.argmax(axis=1) == labels)[kept].mean() >= 0.99


def test_toxicity_on_held_out_documents(spark):
    docs = read_table(spark, SF, "documents")
    rows = toxicity.toxicity_query(spark, SF).join(read_table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert toxicity.toxicity_query(spark, SF).count() == docs.count()
    toxic, clean = ([r for r in rows if r.toxic == c] for c in (1, 0))
    assert np.mean([r.predicted for r in toxic]) > 0.85
    assert np.mean([r.predicted for r in clean]) < 0.01
    assert all((r.score >= 0.5) == r.predicted and 0 <= r.score <= 1 for r in rows)


def test_toxicity_of_odd_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (3, 1, 0), (99, 0, 1), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    docs = odd_documents(spark)
    for taught in (labels, labels.limit(0)):
        model = toxicity.fit(docs, taught)
        found = toxicity.score(docs, model)
        assert found.count() == len(odd_rows())
        assert all(0 <= r["score"] <= 1 for r in found.select("score").collect())
    assert toxicity.score(no_documents(spark), model).count() == 0
    folder = write_tables(spark, str(tmp_path), labels=labels)
    kept = toxicity.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns and set(CLASHES) <= set(kept.columns)


def test_lexicon_alone_decides_without_labels(spark):
    docs = spark.createDataFrame([(1, "You IDIOT, what trash!"), (2, "a fine day")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.row.doc_id: r.predicted for r in toxicity.score(docs, model).collect()} == {1: 1, 2: 0}


def test_label_model_learns_rates_label_noise_and_shares_weight_among_copies():
    rng = np.random.default_rng(2)
    truth = rng.random(6000) < 0.2
    labels = (truth ^ (rng.random(6000) < 0.1)).astype(int)
    fire = lambda p1, p0: rng.random(6000) < np.where(truth, p1, p0)
    first = fire(0.7, 0.05)
    fires = np.column_stack([first, first, first, fire(0.6, 0.02), fire(0.5, 0.01), fire(0.2, 0.2)]).astype(float)
    model, posterior = toxicity.fit_label_model(fires, labels)
    assert abs(model.toxic_rate[3] - 0.6) < 0.06 and abs(model.clean_rate[3] - 0.02) < 0.02
    assert abs(model.toxic_rate[5] - model.clean_rate[5]) < 0.05
    assert model.correlation[0, 1] > 0.9 and model.weight[0] < 0.4 < 0.9 < model.weight[3]
    assert abs(model.label_rates[0] - 0.9) < 0.07 and abs(model.label_rates[1] - 0.1) < 0.05
    assert ((posterior > 0.5) == truth).mean() > (labels == truth).mean()


def test_toxicity_fits_on_the_features_it_scores(spark, monkeypatch):
    seen, fit_logistic = [], toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, *rest: seen.append(x) or fit_logistic(x, *rest))
    docs, labels = (read_table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    matcher = toxicity.Matcher(model.keys)
    texts = [r.text for r in docs.join(labels.where("toxic IN (0, 1)"), "doc_id").select("text").collect()]
    want = [model.features(*toxicity.votes(text, matcher)).round(9).tolist() for text in texts]
    assert sorted(seen[0].round(9).tolist()) == sorted(want)


def test_copies_of_a_hot_text_cost_no_language(spark):
    """One text with thousands of copies, few texts of another language: both are learned."""
    hot = [("en", f"the water of the river was cold {i}") for i in range(20)]
    rows = [(i, *hot[i % 20][::-1]) for i in range(6000)] + [(10_000 + i, f"das ist ein anderer kurzer satz nummer {i}", "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, max_rows=100)
    assert model.languages == ("de", "en")
    sampled = language_id.sample_rows(docs, "text", F.col("lang"), 100)
    assert sampled.count() == sampled.select("text").distinct().count()
    assert sampled.where("label = 'en'").count() == 20


def test_held_out_labels_change_no_model(spark):
    docs = read_table(spark, SF, "documents")
    labels = read_table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", F.when(language_id.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    taught = lambda table: toxicity.fit(docs.where(~language_id.held_out()), table.where(~language_id.held_out()), max_rows=60)
    one, other = taught(labels), taught(flipped)
    assert one.keys == other.keys and one.beta.tolist() == other.beta.tolist()


def test_scored_texts_go_to_the_tasks_once(spark, monkeypatch):
    """A text is sent inside its row, not beside it again; slices of batches are cut by it."""
    seen, map_slices = [], toxicity.map_slices
    monkeypatch.setattr(toxicity, "map_slices", lambda df, *rest: seen.append(df.columns) or map_slices(df, *rest))
    model = toxicity.ToxicityModel(("=idiot",), np.zeros(1 + toxicity.feature_count(1)), frozenset({0}))
    model.beta[0], model.beta[-2] = -2.0, 4.0
    docs = spark.createDataFrame([(1, "you idiot"), (2, None), (3, "fine")], "doc_id long, text string")
    found = {r.row.doc_id: (r.row.text, r.predicted) for r in toxicity.score(docs, model).collect()}
    assert seen == [["row"]]
    assert found == {1: ("you idiot", 1), 2: (None, 0), 3: ("fine", 0)}
    texts = ["aaaa", "bb", None, "c", "dddd"]
    batch = pa.RecordBatch.from_pylist([{"row": {"id": i, "text": text}} for i, text in enumerate(texts)]).slice(1)
    assert common.column_of(batch, "row.text").to_pylist() == texts[1:]
    assert [common.column_of(part, "row.text").to_pylist() for part in common.sliced([batch], "row.text", 3)] == [["bb", None, "c"], ["dddd"]]
