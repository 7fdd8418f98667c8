"""Record files, client tables and run logs."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trustframe.operators import partition
from trustframe.plans import analytics
from trustframe.sources import records, runs


def line(i, label="normal.", sep=",", difficulty=True):
    values = []
    for name in records.FEATURES:
        values.append({"protocol_type": "tcp", "service": f"s{i % 3}", "flag": "SF"}.get(name, str(i)))
    return sep.join(values + [label] + (["21"] if difficulty else []))


def test_names():
    assert len(records.FEATURES) == 41 and len(records.NUMERICAL) == 38
    assert records.column_names(42)[-1] == "label" and records.column_names(43)[-2:] == ["label", "difficulty"]
    assert records.column_names(4) == ["c0", "c1", "label", "difficulty"] and records.column_names(1) == ["c0"]


@pytest.mark.parametrize("sep,difficulty", [(",", True), (",", False), ("   ", True), (" ", False)])
def test_read_records(spark, tmp_path, sep, difficulty):
    path = tmp_path / "train.txt"
    path.write_text("\n".join(line(i, "neptune." if i % 2 else "normal", sep, difficulty) for i in range(20)) + "\n")
    layout = records.detect_layout(spark, str(path))
    assert layout == ("," if sep == "," else "whitespace", 43 if difficulty else 42)
    rows = records.read_records(spark, str(path))
    assert rows.columns == ["row_id", *records.FEATURES, "label"]
    assert rows.count() == rows.select("row_id").distinct().count() == 20
    first = rows.where("duration = 3").first()
    assert first["service"] == "s0" and first["src_bytes"] == 3.0 and first["label"] == "neptune"
    profile = records.dataset_profile(rows)
    assert profile == {"rows": 20, "columns": 43, "labels": [("neptune", 10), ("normal", 10)]}


def test_layout_votes(spark, tmp_path):
    for name, text, want in [("empty", "", "whitespace"), ("one", "a,b\nc d\ne f\n", ","), ("few", "a b\nc,d\ne f\ng h\n", "whitespace")]:
        (tmp_path / name).write_text(text)
        assert records.detect_layout(spark, str(tmp_path / name))[0] == want
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path / "missing")).count()
    with pytest.raises(ValueError):
        records.read_records(spark, str(tmp_path / "empty"))


@pytest.mark.parametrize("copies_per_task", [100_000, 7])
def test_row_ids_of_copies(spark, copies_per_task):
    rows = spark.range(500).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"), F.lit(None).cast("string").alias("b"))
    ids = lambda df: sorted(r["row_id"] for r in records.with_row_id(df, copies_per_task).collect())
    got = ids(rows.repartition(1))
    assert len(set(got)) == 500 and got == ids(rows.repartition(13))
    hot = records.with_row_id(rows, copies_per_task).where("a = 0")
    numbers = sorted(int(r["row_id"].split("-")[1]) for r in hot.collect())
    assert numbers == list(range(1, 168))


@pytest.mark.parametrize("copies_per_task", [100_000, 50])
def test_copies_are_written_out_by_many_tasks(spark, copies_per_task):
    """A few distinct rows, however small, are not put into one task: 40 of 200 copies each."""
    rows = spark.range(8000, numPartitions=3).select((F.col("id") % 40).alias("a"))
    numbered = records.with_row_id(rows, copies_per_task).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in numbered.groupBy("task").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 1000


def test_row_ids_tell_nulls_apart(spark):
    rows = spark.createDataFrame(
        [(5.0, None, "a", [None, 1]), (None, 5.0, "a", [None, 1]), (5.0, None, "a", [1, None])],
        "x double, y double, label string, nested array<int>",
    )
    ids = [r["row_id"] for r in records.with_row_id(rows).collect()]
    assert len(set(ids)) == 3 and all(name.endswith("-1") for name in ids)


def test_client_tables(spark, tmp_path):
    path = tmp_path / "train.txt"
    path.write_text("\n".join(line(i, "smurf" if i % 2 else "normal") for i in range(40)))
    from trustframe.functions.labels import with_family

    rows = with_family(records.read_records(spark, str(path)))
    specs = partition.specs_table(spark, [(f"c{i}", {"normal": 0.5, "dos": 0.5}) for i in range(12)])
    dealt = partition.split_non_iid(rows, specs, 2, seed=1)
    records.write_client_tables(dealt, str(tmp_path / "clients"))
    manifest = partition.split_manifest(dealt, specs, 2, 1)
    partition.write_manifest(manifest, str(tmp_path / "manifest"), "train.txt", str(tmp_path / "clients"))
    described = partition.read_manifest(spark, str(tmp_path / "manifest")).collect()
    assert len(described) == 12 and {d["n_clients"] for d in described} == {12}
    assert described[0]["family_counts"] == {"dos": 1, "normal": 1} and described[0]["source"] == "train.txt"
    back = records.read_client_tables(spark, str(tmp_path / "clients"))
    assert "family" not in back.columns and "shuffle_key" not in back.columns
    assert {r["client_id"]: r["count"] for r in back.groupBy("client_id").count().collect()} == {i: 2 for i in range(1, 13)}


def test_manifest_is_one_object(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("r"), F.col("id")).alias("row_id"), F.when(F.col("id") % 2 == 0, "dos").otherwise("normal").alias("family"), F.col("id").cast("double").alias("duration"))
    specs = partition.specs_table(spark, [(f'c "{i}"', {"normal": 0.5, "dos": 0.5}) for i in range(12)] + [("none", {"probe": 0.0})])
    dealt = partition.split_non_iid(rows, specs, 10, seed=1, fill=False)
    manifest = partition.split_manifest(dealt, specs, 10, 1)
    partition.write_manifest(manifest, str(tmp_path / "manifest"), "train.txt", "out")
    (file,) = (tmp_path / "manifest").glob("part-*")
    whole = json.loads(file.read_text())
    assert {k: whole[k] for k in ("n_clients", "client_size", "seed", "source", "output_dir")} == {"n_clients": 13, "client_size": 10, "seed": 1, "source": "train.txt", "output_dir": "out"}
    assert [spec["name"] for spec in whole["specs"]] == [f'c "{i}"' for i in range(12)] + ["none"]
    assert whole["specs"][0]["proportions"] == {"normal": 0.5, "dos": 0.5}
    assert whole["clients"]['c "3"'] == {"client_id": 4, "rows": 10, "family_counts": {"dos": 5, "normal": 5}}
    assert whole["clients"]["none"] == {"client_id": 13, "rows": 0, "family_counts": {}}
    back = {r["client_id"]: r for r in partition.read_manifest(spark, str(tmp_path / "manifest")).collect()}
    assert len(back) == 13 and back[4]["family_counts"] == {"dos": 5, "normal": 5} and back[13]["proportions"] == {"probe": 0.0}
    records.write_client_csv(dealt, str(tmp_path / "shards"))
    shards = records.read_client_csv(spark, str(tmp_path / "shards"))
    assert {r["client_id"]: r["count"] for r in shards.groupBy("client_id").count().collect()} == {i: 10 for i in range(1, 13)}
    assert shards.agg(F.sum("duration")).first()[0] == dealt.agg(F.sum("duration")).first()[0] and "family" not in shards.columns


@pytest.mark.parametrize("few_files", [16, 0])
def test_a_folder_of_different_layouts(spark, tmp_path, few_files, monkeypatch):
    monkeypatch.setattr(records, "FEW_FILES", few_files)
    monkeypatch.setattr(records.file_heads, "__defaults__", (records.SAMPLE_LINES, few_files))
    for name, sep, difficulty in (("a b.txt", ",", True), ("b.txt", " ", False), ("c.txt", " , ", False), ("d.txt", "\t", True)):
        (tmp_path / name).write_text("\n".join(line(i, "neptune." if i % 2 else "normal", sep, difficulty) for i in range(20)) + "\n\n")
    (tmp_path / "empty.txt").write_text("")
    assert sorted(records.detect_layouts(spark, str(tmp_path))) == [(",", 42), (",", 43), ("whitespace", 42), ("whitespace", 43)]
    rows = records.read_records(spark, str(tmp_path))
    assert rows.columns == ["row_id", *records.FEATURES, "label"]
    assert rows.count() == rows.select("row_id").distinct().count() == 80
    got = rows.groupBy("duration", "service", "label").count().collect()
    assert len(got) == 20 and {r["count"] for r in got} == {4}


def test_quoted_fields(spark, tmp_path):
    (tmp_path / "q.txt").write_text('"a,b", 1.5 ,"x ""y""",normal.,3\n,,"",neptune,\n')
    rows = sorted(map(tuple, records.read_records(spark, str(tmp_path), keep_row_id=False).collect()), key=repr)
    assert rows == [("a,b", "1.5", 'x "y"', "normal"), (None, None, None, "neptune")]


def test_client_csv_numbers_come_from_names(spark, tmp_path):
    for client in (1, 2, 10):
        text = ",".join([*records.FEATURES, "label"]) + "\n" + "\n".join(line(client, difficulty=False) for _ in range(client))
        (tmp_path / f"client_{client}.csv").write_text(text)
    rows = records.read_client_csv(spark, str(tmp_path))
    got = {r["client_id"]: (r["count"], r["d"]) for r in rows.groupBy("client_id").agg(F.count("*").alias("count"), F.max("duration").alias("d")).collect()}
    assert got == {1: (1, 1.0), 2: (2, 2.0), 10: (10, 10.0)}
    assert rows.first()["label"] == "normal"
    with pytest.raises(Exception):
        records.read_client_csv(spark, str(tmp_path / "none")).count()


def test_run_store(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "store"))
    name = store.start_run({"rounds": 2}, {"n_clients": 3})
    assert name != store.start_run({"rounds": 1})
    rounds = spark.createDataFrame([(1, 0.5), (2, 0.6)], "round int, accuracy double")
    store.log_rounds(name, rounds.withColumn("logged_at", F.lit("2024-01-01 00:00:00").cast("timestamp")))
    store.log_rounds(name, rounds.where("round = 2").withColumns({"accuracy": F.lit(0.9), "trust_mean": F.lit(0.7)}))
    feedback = spark.createDataFrame([(1, 1, True, 0.5), (1, 2, False, 0.1)], "round int, client_id long, used boolean, trust double")
    store.log_feedback(name, feedback)
    assert {r["run_name"]: json.loads(r["config"]) for r in store.runs().collect()}[name] == {"rounds": 2}
    got = store.rounds().orderBy("round").collect()
    assert [(r["round"], r["accuracy"], r["trust_mean"]) for r in got] == [(1, 0.5, None), (2, 0.9, 0.7)]
    summary = analytics.feedback_summary(store.feedback()).first()
    assert summary["drop_rate"] == 0.5 and summary["trust_separation"] == pytest.approx(0.4)


def test_run_store_keeps_scenarios_and_refuses_unknown_columns(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "store"))
    rows = [(s, r, 0.1 * r, 0.2 * s) for s in (0, 1) for r in (1, 2)]
    rounds = spark.createDataFrame(rows, "scenario_id long, round int, accuracy double, false_negative_rate double")
    for _ in range(2):
        store.log_rounds("run", rounds)
    got = sorted((r["scenario_id"], r["round"], r["accuracy"], r["false_negative_rate"]) for r in store.rounds().collect())
    assert got == sorted(rows)
    feedback = spark.createDataFrame([(0, 1, 7, True), (1, 1, 7, False)], "scenario_id long, round int, client_id long, used boolean")
    store.log_feedback("run", feedback)
    assert sorted((r["scenario_id"], r["used"]) for r in store.feedback().collect()) == [(0, True), (1, False)]
    with pytest.raises(ValueError, match="surprise"):
        store.log_rounds("run", rounds.withColumn("surprise", F.lit(1)))


def test_upserts_leave_one_row_on_disk(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path))
    rows = lambda value, numbers=(1, 2): spark.createDataFrame([(s, r, value) for s in (0, 1) for r in numbers], "scenario_id long, round int, accuracy double")
    on_disk = lambda: sorted((r["scenario_id"], r["round"], r["accuracy"]) for r in spark.read.parquet(str(tmp_path / "rounds")).collect())
    for _ in range(2):  # a retried job
        store.log_rounds("run", rows(0.5), sequence=2)
    assert on_disk() == [(0, 1, 0.5), (0, 2, 0.5), (1, 1, 0.5), (1, 2, 0.5)]
    store.log_rounds("run", rows(0.1), sequence=1)  # late
    assert {r[2] for r in on_disk()} == {0.5}
    store.log_rounds("run", rows(0.9, (2, 3)).where("scenario_id = 1"), sequence=3)
    assert on_disk() == [(0, 1, 0.5), (0, 2, 0.5), (1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.9)]
    store.log_rounds("other", rows(0.2), sequence=1)
    assert len(on_disk()) == 9 and store.rounds().where("run_name = 'run'").count() == 5


def test_one_message_for_a_round_of_any_size(spark):
    rows = spark.range(10_001).select(
        (F.col("id") % 3 % 2 + 1).cast("int").alias("round"), (F.col("id") - 50).alias("client_id"), F.lit(True).alias("used"),
        F.when(F.col("id") % 2 == 0, 0.5).alias("trust"),
    )
    all_in_one = rows.withColumn("round", F.lit(1))
    (message,) = runs.feedback_messages(all_in_one, ["round"]).collect()
    parsed = json.loads(message["value"])
    assert message["n_clients"] == len(parsed["clients"]) == 10_001 and parsed["round"] == 1
    assert [c["client_id"] for c in parsed["clients"]] == list(range(-50, 9951))
    assert parsed["clients"][0] == {"client_id": -50, "used": True, "trust": 0.5} and "trust" not in parsed["clients"][1]
    for size in (7, 10**6):
        found = {r["round"]: json.loads(r["value"]) for r in runs.feedback_messages(rows, ["round"], size).collect()}
        assert {k: len(v["clients"]) for k, v in found.items()} == {1: 6667, 2: 3334}
    (bare,) = runs.feedback_messages(rows.drop("round"), []).collect()
    assert len(json.loads(bare["value"])["clients"]) == 10_001


def test_many_runs_are_merged_in_one_shuffle(spark):
    logs = {f"r{i}": spark.createDataFrame([(1, 0.1 * i)], "round int, accuracy double").withColumn(f"own{i}", F.lit(i)) for i in range(12)}
    logs["point"] = spark.createDataFrame([(0.7,)], "accuracy double")
    merged = analytics.merge_runs(logs)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r["run_name"]: r for r in merged.collect()}
    assert len(got) == 13 and got["r3"]["own3"] == 3 and got["r3"]["own4"] is None and got["point"]["round"] == 1


def test_nested_feedback_in_parts(spark):
    rows = spark.range(1, 101).select(
        F.lit(1).alias("round"), F.col("id").alias("client_id"), F.lit(True).alias("used"), F.lit(None).cast("double").alias("trust")
    )
    one = runs.nest_feedback(rows, ["round"])
    assert one.count() == 1 and len(one.first()["clients"]) == 100
    assert json.loads(runs.feedback_json(one).first()["value"])["clients"][0] == {"client_id": 1, "used": True}
    parts = runs.nest_feedback(rows, ["round"], clients_per_row=10)
    assert parts.count() > 1
    assert sorted(r["client_id"] for r in runs.explode_feedback(parts).collect()) == list(range(1, 101))


def test_round_files(spark, tmp_path):
    def write(run, name, text):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_text(text)

    stamp = lambda s: f"2024-01-01T00:00:0{s}+00:00"
    write("a", "rounds.json", json.dumps([{"round": 2, "logged_at": stamp(2), "accuracy": 0.2, "trust_mean": 0.3}, {"round": 1, "logged_at": stamp(1), "accuracy": 0.1}], indent=2))
    write("a", "rounds.csv", f"round,logged_at,accuracy\n9,{stamp(9)},0.9\n")
    write("b", "rounds.csv", f"round,logged_at,accuracy,recall\n1,{stamp(1)},0.5,\n1,{stamp(2)},0.6,0.7\n")
    write("c", "rounds.csv", "accuracy\n0.4\n")
    (tmp_path / "empty").mkdir()
    raw = runs.read_round_files(spark, str(tmp_path))
    got = {(r["run_name"], r["round"]): r for r in runs.latest_rounds(raw).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("c", 1)}
    assert got[("a", 2)]["trust_mean"] == 0.3 and got[("b", 1)]["recall"] == 0.7 and got[("c", 1)]["accuracy"] == 0.4
    assert got[("a", 1)]["logged_at"] == datetime(2024, 1, 1, 0, 0, 1)
    with pytest.raises(Exception, match="no round column"):
        runs.read_round_files(spark, str(tmp_path), strict=True).collect()
    with pytest.raises(FileNotFoundError):
        runs.read_round_files(spark, str(tmp_path / "empty"))
    assert [r["round"] for r in runs.read_run(spark, str(tmp_path / "a")).orderBy("round").collect()] == [1, 2]
    assert runs.read_run(spark, str(tmp_path / "b" / "rounds.json")).count() == 2
    assert runs.read_run(spark, str(tmp_path / "b" / "rounds.csv")).first()["run_name"] == "b"
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, str(tmp_path / "empty"))
    merged = analytics.merge_runs({"a": raw.where("run_name = 'a'").drop("run_name"), "b": raw.where("run_name = 'b'").drop("run_name")})
    runs.write_merged(merged, str(tmp_path / "merged"))
    assert spark.read.csv(str(tmp_path / "merged_csv"), header=True).count() == 3
    assert spark.read.json(str(tmp_path / "merged_json")).count() == 3
    final = analytics.final_rounds(merged)
    assert {r["run_name"]: r["round"] for r in final.collect()} == {"a": 2, "b": 1}
    assert final.columns[:4] == ["run_name", "round", "accuracy", "precision"]


def test_feedback_files(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "client_feedback.json").write_text(
        json.dumps([{"round": 1, "logged_at": "2024-01-01T00:00:00+00:00", "clients": [{"client_id": 1, "trust": 0.9}, {"client_id": 2, "used": False, "trust": 0.2}, {"client_id": 3, "used": True}]}])
    )
    rows = runs.read_feedback_files(spark, str(tmp_path))
    got = analytics.feedback_summary(rows).first()
    assert got["run_name"] == "r1" and got["drop_rate"] == pytest.approx(1 / 3)
    assert got["trust_used_mean"] == 0.9 and got["trust_dropped_mean"] == 0.2


def test_run_choice_and_signals(spark):
    rounds = spark.createDataFrame(
        [("a", 1, 0.5, None, 0.1), ("b", 1, 0.6, 0.3, 0.2), ("c", 1, 0.7, None, None)],
        "run_name string, round int, accuracy double, trust_mean double, cross_layer_mean double",
    )
    names = lambda df: sorted(r["run_name"] for r in df.collect())
    assert names(analytics.select_runs(rounds, ["b", " c ", "zzz"])) == ["b", "c"]
    assert names(analytics.select_runs(rounds)) == ["a", "b", "c"]
    assert names(analytics.select_runs(rounds, standard=["a", "b"])) == ["a", "b"]
    assert names(analytics.select_runs(rounds, standard=["a", "zzz"])) == ["a", "b", "c"]
    assert names(analytics.select_runs(rounds, skip_prefix="a")) == ["b", "c"]
    signals = {r["run_name"]: (r["signal"], r["value"]) for r in analytics.defense_signal(rounds).collect()}
    assert signals == {"a": ("cross_layer_mean", 0.1), "b": ("trust_mean", 0.3), "c": ("accuracy", 0.7)}


def test_attacker_rank(spark):
    feedback = spark.createDataFrame(
        [("r", 1, 1, 0.1), ("r", 1, 2, 0.9), ("r", 1, 3, 0.5), ("r", 2, 1, 0.8), ("r", 2, 2, 0.2), ("r", 2, 3, None)],
        "run_name string, round int, client_id long, trust double",
    )
    attackers = spark.createDataFrame([(1,)], "client_id long")
    row = analytics.attacker_rank(feedback, attackers, 1).first()
    assert row["attacker_rows"] == 2 and row["hits"] == 1 and row["bottom_share"] == 0.5
    assert row["attacker_trust_mean"] == pytest.approx(0.45) and row["benign_trust_mean"] == pytest.approx(1.6 / 3)
