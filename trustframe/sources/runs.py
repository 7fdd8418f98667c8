"""Run logs as tables: run configurations, round metrics, client feedback and model states, and readers for files.

Rounds and feedback are upserted by key into partitions of run and round: what is logged again replaces the earlier
row on disk, by sequence number, and a job that is run twice leaves one row (see ``upsert``).
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trustframe.operators.materialize import cut_lineage, join_checked, literal_table, settle
from trustframe.sources.upsert import existing, highest, replace_partitions, upsert

# Names of logged metrics, diagnostics and feedback fields.
METRICS = ["accuracy", "precision", "recall", "f1", "false_positive_rate"]
DIAGNOSTICS = [
    "cosine_sim_min", "cosine_sim_mean", "trust_min", "trust_mean", "loss_stability_mean", "cross_layer_mean",
    "dropped_clients",
]
ROUND_SCHEMA = "run_name string, scenario_id long, round int, logged_at timestamp, sequence long, " + ", ".join(
    f"{name} double" for name in [*METRICS, "false_negative_rate", *DIAGNOSTICS]
)
FEEDBACK_SCHEMA = (
    "run_name string, scenario_id long, round int, logged_at timestamp, sequence long, client_id long, used boolean, "
    "trust double, cosine_similarity double, loss_stability double, cross_layer double, notes string"
)
CLIENT_SCHEMA = (
    "struct<client_id: bigint, used: boolean, trust: double, cosine_similarity: double, loss_stability: double, "
    "cross_layer: double, notes: string>"
)
STATE_SCHEMA = "run_name string, scenario_id int, round int, weights array<double>"
PROGRESS_SCHEMA = "run_name string, round int, fingerprint string"
PARTITIONS = ["run_name", "round"]
RUN_SCHEMA = "run_name string, created_at timestamp, config string, meta string"
CLIENTS_PER_ROW = 10_000


def new_run_name(moment: datetime | None = None) -> str:
    """Sortable by time, and different for runs started in the same second."""
    moment = moment or datetime.now(timezone.utc)
    return f"{moment:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


@dataclass(frozen=True)
class RunStore:
    """Folder with the tables ``runs``, ``rounds`` and ``feedback``. Errors while writing are not hidden."""

    spark: SparkSession
    root: str

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def start_run(self, config: dict, meta: dict | None = None, run_name: str | None = None) -> str:
        run_name = run_name or new_run_name()
        row = (run_name, datetime.now(timezone.utc), json.dumps(config, default=str), json.dumps(meta or {}))
        literal_table(self.spark, [row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(self._path("runs"))
        return run_name

    def log_rounds(self, run_name: str, rounds: DataFrame, sequence: int | None = None) -> None:
        """Upsert rounds by run, scenario and round; columns that a strategy does not produce are stored as null.

        ``sequence`` orders writes of one key; without it rows count in the order in which they were logged. Columns
        that the table does not have raise.
        """
        self._upsert("rounds", ROUND_SCHEMA, run_name, rounds, ["run_name", "scenario_id", "round"], sequence)

    def log_feedback(self, run_name: str, feedback: DataFrame, sequence: int | None = None) -> None:
        """Upsert feedback by run, scenario, round and client."""
        keys = ["run_name", "scenario_id", "round", "client_id"]
        self._upsert("feedback", FEEDBACK_SCHEMA, run_name, feedback, keys, sequence)

    def _upsert(
        self, name: str, schema: str, run_name: str, rows: DataFrame, keys: list[str], sequence: int | None
    ) -> None:
        fields = T._parse_datatype_string(schema).fields
        stamped = rows if "logged_at" in rows.columns else rows.withColumn("logged_at", F.current_timestamp())
        stamped = stamped.withColumn("run_name", F.lit(run_name))
        number = F.unix_micros("logged_at") if sequence is None else F.lit(int(sequence))
        if "sequence" not in stamped.columns:
            stamped = stamped.withColumn("sequence", number)
        unknown = sorted(set(stamped.columns) - {f.name for f in fields})
        if unknown:
            raise ValueError(f"{name} has no column {', '.join(unknown)}")
        columns = [
            (F.col(f.name) if f.name in stamped.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
        ]
        order = ["sequence", "logged_at", *[f.name for f in fields if f.name not in (*keys, "sequence", "logged_at")]]
        upsert(stamped.select(*columns), self._path(name), keys, PARTITIONS, order)

    def save_round(self, run_name: str, round_no: int, states: DataFrame, fingerprint: str) -> None:
        """Write the model states after a round, then mark the round as complete.

        The mark is the last write of a round: a run that stops before it starts the round anew.
        """
        columns = [F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(STATE_SCHEMA) if f.name not in PARTITIONS]
        stamped = states.select(*columns, F.lit(run_name).alias("run_name"), F.lit(int(round_no)).alias("round"))
        replace_partitions(cut_lineage(stamped), self._path("states"), PARTITIONS)
        mark = literal_table(self.spark, [(run_name, int(round_no), fingerprint)], PROGRESS_SCHEMA).coalesce(1)
        replace_partitions(mark, self._path("progress"), PARTITIONS)

    def states(self) -> DataFrame:
        return self._read("states", STATE_SCHEMA)

    def last_complete(self, run_name: str, fingerprint: str) -> int | None:
        """The last round up to which the run is complete; None for a new run. Another ``fingerprint`` raises."""
        marks = existing(self.spark, self._path("progress"), T._parse_datatype_string(PROGRESS_SCHEMA))
        marks = [] if marks is None else marks.where(F.col("run_name") == run_name).collect()  # a row for each round
        if any(mark["fingerprint"] != fingerprint for mark in marks):
            raise ValueError(f"run {run_name} was started with another configuration")
        done = {mark["round"] for mark in marks}
        return next((n for n in sorted(done) if n + 1 not in done), None) if 0 in done else None

    def _read(self, name: str, schema: str) -> DataFrame:
        fields = T._parse_datatype_string(schema)
        return self.spark.read.schema(fields).parquet(self._path(name)).select(*fields.names)

    def runs(self) -> DataFrame:
        return self._read("runs", RUN_SCHEMA)

    def rounds(self) -> DataFrame:
        """The row logged last of each run, scenario and round."""
        return self._read("rounds", ROUND_SCHEMA).drop("sequence")

    def feedback(self) -> DataFrame:
        return self._read("feedback", FEEDBACK_SCHEMA).drop("sequence")


def latest_rounds(
    rounds: DataFrame, run: str = "run_name", tie: Sequence[str] = (), within: Sequence[str] = ()
) -> DataFrame:
    """Keep the row logged last of each run and round (and of each value of ``within``): what an upsert would have left.

    Rows logged at the same time are told apart by ``tie`` and then by their other plain columns. A log without ``round`` is a single point, round 1. Works as an aggregate, so repeated rounds are reduced before
    the shuffle however often they were logged.
    """
    if "round" not in rounds.columns:
        rounds = rounds.withColumn("round", F.lit(1))
    rounds = rounds.withColumn("round", F.col("round").cast("int"))
    keys = [run, *within, "round"]
    rest = [f for f in rounds.schema.fields if f.name not in keys]
    plain = [f.name for f in rest if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = list(dict.fromkeys(name for name in ("logged_at", *tie, *plain) if name in rounds.columns))
    return highest(rounds, keys, order)


def nest_feedback(
    feedback: DataFrame, keys: Sequence[str] = ("run_name", "round"), clients_per_row: int = CLIENTS_PER_ROW
) -> DataFrame:
    """Feedback as exported: ``(keys..., clients array<struct>)``, one message per round.

    A round of more than ``clients_per_row`` clients is written as several messages of about that size, each with
    its part of the clients; readers go through all messages of a round.
    """
    keys = list(keys)
    sizes = feedback.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(clients_per_row)).alias("_parts"))
    clients = F.struct(*[name for name in feedback.columns if name not in (*keys, "logged_at")])
    parted = join_checked(feedback, settle(sizes), keys).withColumn("_part", F.pmod(F.xxhash64("client_id"), F.col("_parts")))
    grouped = parted.groupBy(*keys, "_part").agg(F.sort_array(F.collect_list(clients)).alias("clients"))
    return grouped.drop("_part")


def feedback_messages(
    feedback: DataFrame, keys: Sequence[str] = ("run_name", "round"), clients_per_part: int = CLIENTS_PER_ROW
) -> DataFrame:
    """``(keys..., n_clients, value)``: one JSON message ``{keys, "clients": [...]}`` for each round of any size.

    Clients are in order of their id; null fields are left out. The text is put together from parts of about
    ``clients_per_part`` clients with ids next to each other, which many tasks write; one task joins the finished
    parts of a round.
    """
    keys = list(keys)
    fields = [name for name in feedback.columns if name not in (*keys, "logged_at")]
    without_nulls = {"ignoreNullFields": "true"}
    texts = feedback.select(*keys, "client_id", F.to_json(F.struct(*fields), without_nulls).alias("_text"))
    part = F.floor(F.col("client_id") / F.lit(clients_per_part))
    parts = texts.groupBy(*keys, part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("client_id", "_text"))).alias("_rows")
    )
    joined = F.array_join(F.transform("_rows", lambda row: row["_text"]), ",")
    whole = parts.select(*keys, "_part", "_n", joined.alias("_text")).groupBy(*keys).agg(
        F.sum("_n").alias("n_clients"), F.sort_array(F.collect_list(F.struct("_part", "_text"))).alias("_parts")
    )
    head = F.to_json(F.struct(*keys), without_nulls) if keys else F.lit("{}")
    opened = F.expr("substr(_head, 1, length(_head) - 1)")
    clients = F.concat(F.lit('"clients":['), F.array_join(F.transform("_parts", lambda p: p["_text"]), ","), F.lit("]}"))
    messages = whole.withColumn("_head", head).withColumn("_open", opened)
    comma = F.when(F.col("_open") == "{", F.lit("")).otherwise(F.lit(","))
    return messages.select(*keys, "n_clients", F.concat("_open", comma, clients).alias("value"))


def feedback_json(nested: DataFrame) -> DataFrame:
    """One JSON text per message; null fields are left out."""
    return nested.select(F.to_json(F.struct(*nested.columns), {"ignoreNullFields": "true"}).alias("value"))


def explode_feedback(nested: DataFrame) -> DataFrame:
    """Exported messages back to one row per client; a missing ``used`` counts as used."""
    rest = [name for name in nested.columns if name != "clients"]
    rows = nested.select(*rest, F.inline("clients"))
    return rows.withColumn("used", F.coalesce("used", F.lit(True)))


def write_merged(merged: DataFrame, path: str) -> None:
    """Merged metrics side by side as CSV with a header and as JSON records."""
    merged.write.mode("errorifexists").csv(f"{path}_csv", header=True)
    merged.write.mode("errorifexists").json(f"{path}_json", ignoreNullFields=False)


def _run_of_file():
    return F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def _read_if_any(read: Callable[[str], DataFrame], pattern: str) -> DataFrame | None:
    try:
        return read(pattern)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_round_files(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """Round logs of every run below ``root``: ``<root>/<run>/rounds.json`` or ``<root>/<run>/rounds.csv``.

    Runs are told by their folder; a run that has both files is read from the JSON one. ``strict`` makes a log
    without a ``round`` column an error. Repeated rounds are not removed here, see ``latest_rounds``.
    """
    return _read_logs(spark, f"{root.rstrip('/')}/*/rounds.json", f"{root.rstrip('/')}/*/rounds.csv", strict)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Round log of one run, given its folder or one of its files. A log without ``round`` is an error."""
    stem = path.rstrip("/")
    stem = stem.rsplit(".", 1)[0] if stem.endswith((".json", ".csv")) else f"{stem}/rounds"
    return _read_logs(spark, f"{stem}.json", f"{stem}.csv", strict=True)


def _read_logs(spark: SparkSession, json_files: str, csv_files: str, strict: bool) -> DataFrame:
    """JSON files hold an array of records, CSV files a header and lines; JSON is preferred by run."""
    columns = T._parse_datatype_string(ROUND_SCHEMA.replace("run_name string, ", "").replace("sequence long, ", ""))
    frames = []
    records = _read_if_any(spark.read.option("multiLine", True).schema(columns).json, json_files)
    if records is not None:
        frames.append(records.withColumn("run_name", _run_of_file()))
    texts = _read_if_any(lambda pattern: spark.read.text(pattern, wholetext=True), csv_files)
    if texts is not None:
        # One small file per run; columns differ by strategy, so every file is read by its own header line.
        lines = texts.withColumn("run_name", _run_of_file())
        body = lines.select("run_name", F.split(F.trim("value"), r"\r?\n").alias("lines"))
        rows = body.select(
            "run_name", F.split(F.col("lines")[0], ",").alias("names"), F.posexplode("lines").alias("_no", "line")
        ).where("_no > 0 AND line <> ''")
        cells = F.map_from_arrays("names", F.split("line", ",", -1))
        csv = rows.select(*[_cell(cells, f) for f in columns.fields], "run_name")
        if frames:
            csv = csv.join(frames[0].select("run_name").distinct(), "run_name", "left_anti").select(*csv.columns)
        frames.append(csv)
    if not frames:
        raise FileNotFoundError(f"no round logs at {json_files} or {csv_files}")
    rounds = functools.reduce(DataFrame.unionByName, frames)
    if strict:
        missing = F.raise_error(F.concat(F.lit("no round column in the log of "), F.col("run_name"))).cast("int")
        rounds = rounds.withColumn("round", F.coalesce("round", missing))
    else:
        rounds = rounds.withColumn("round", F.coalesce("round", F.lit(1)))
    return rounds.select("run_name", *columns.names)


def _cell(cells, field: T.StructField):
    """Typed value of a named CSV cell; counts may be written as ``1.0``."""
    text = F.nullif(cells[field.name], F.lit(""))
    if isinstance(field.dataType, T.IntegerType):
        return text.try_cast("double").cast("int").alias(field.name)
    return text.try_cast(field.dataType).alias(field.name)


def read_feedback_files(spark: SparkSession, root: str) -> DataFrame:
    """Feedback exported as ``<root>/<run>/client_feedback.json``, one row per client."""
    schema = f"round int, logged_at timestamp, clients array<{CLIENT_SCHEMA}>"
    nested = spark.read.option("multiLine", True).schema(schema).json(f"{root}/*/client_feedback.json")
    return explode_feedback(nested.withColumn("run_name", _run_of_file()))
