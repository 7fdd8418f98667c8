"""Reading labelled connection records and client tables, and profiling them."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trustframe.functions.labels import normalize_label
from trustframe.operators.materialize import any_path
from trustframe.operators.rank import first_k

# Feature names of the public KDD'99 family of datasets, in file order.
FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent",
    "hot", "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root",
    "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login",
    "count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate",
    "diff_srv_rate", "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate",
    "dst_host_diff_srv_rate", "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]
CATEGORICAL = ["protocol_type", "service", "flag"]
NUMERICAL = [name for name in FEATURES if name not in CATEGORICAL]
DIFFICULTY = ("difficulty", "difficulty_level")

COMMA = ","
WHITE_SPACE = "whitespace"
QUOTED_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
COPIES_PER_TASK = 100_000
# Tasks that copies are dealt to, by core.
TASKS_PER_CORE = 32
NESTED = (T.ArrayType, T.MapType, T.StructType)


def column_names(width: int) -> list[str]:
    """Names by column count: features and label, with a difficulty column when there is one more.

    Other widths get numbered names, the last two being label and difficulty.
    """
    known = [*FEATURES, "label", "difficulty"]
    if width in (len(known) - 1, len(known)):
        return known[:width]
    numbered = [f"c{i}" for i in range(width)]
    return numbered[:-2] + ["label", "difficulty"] if width >= 2 else numbered


def record_schema(names: Sequence[str]) -> T.StructType:
    """Strings for categories and label, doubles for every other known name; strings when the layout is unknown."""
    known = set(NUMERICAL) | set(DIFFICULTY)
    text = [name for name in names if name not in known]
    return T.StructType(
        [T.StructField(name, T.StringType() if name in text else T.DoubleType()) for name in names]
    )


SAMPLE_LINES = 5
# Heads of up to so many files are read one by one, which reads little else; those of more files in one scan.
FEW_FILES = 16


def file_heads(spark: SparkSession, path: str, sample_lines: int = SAMPLE_LINES, few_files: int = FEW_FILES) -> dict[str, list[str]]:
    """The first lines of each file at ``path``."""
    files = spark.read.text(path).inputFiles()
    if len(files) <= few_files:
        return {file: [row[0] for row in spark.read.text(unquote(file)).limit(sample_lines).collect()] for file in files}
    # The start of a file is read by one task from top to bottom, so its lines have rising numbers there.
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("number"), "value"
    )
    found: dict[str, list[str]] = {file: [] for file in files}
    for row in first_k(lines, ["file"], [F.col("number").asc()], sample_lines).orderBy("number").collect():
        found.setdefault(row["file"], []).append(row["value"])
    return found


def layout_of(lines: Sequence[str]) -> tuple[str, int]:
    """Delimiter and column count by the first lines of a file; an empty file reads as white space, 0 columns.

    The file is comma separated when at least half of the lines, and at least one, hold a comma.
    """
    lines = [text.strip() for text in lines]
    if not lines:
        return WHITE_SPACE, 0
    votes = sum(COMMA in line for line in lines)
    delimiter = COMMA if votes >= max(1, len(lines) // 2) else WHITE_SPACE
    if not lines[0]:
        return delimiter, 0
    return delimiter, len(lines[0].split() if delimiter == WHITE_SPACE else re.split(QUOTED_COMMA, lines[0]))


def detect_layout(spark: SparkSession, path: str, sample_lines: int = SAMPLE_LINES) -> tuple[str, int]:
    """Delimiter and column count of one file."""
    return layout_of([row[0] for row in spark.read.text(path).limit(sample_lines).collect()])


def detect_layouts(spark: SparkSession, path: str) -> dict[tuple[str, int], list[str]]:
    """Files at ``path`` by their layout; empty files are left out."""
    groups: dict[tuple[str, int], list[str]] = {}
    for file, lines in sorted(file_heads(spark, path).items()):
        layout = layout_of(lines)
        if layout[1]:
            groups.setdefault(layout, []).append(unquote(file))
    return groups


def parse_fields(fields: Column, schema: T.StructType) -> list[Column]:
    """Typed columns of an ``array<string>`` of fields, by position; what is not a number becomes null."""
    out = []
    for i, column in enumerate(schema.fields):
        text = F.get(fields, F.lit(i))
        value = text if isinstance(column.dataType, T.StringType) else F.trim(text).try_cast("double")
        out.append(value.alias(column.name))
    return out


def parse_lines(lines: DataFrame, delimiter: str, schema: T.StructType) -> DataFrame:
    """Records from text lines ``value`` of one layout: typed, without difficulty, with normalised labels."""
    filled = lines.where(F.trim("value") != "")
    if delimiter == COMMA:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        options = {"sep": COMMA, "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
        rows = filled.select(F.from_csv("value", kinds, options).alias("_record")).select("_record.*")
    else:
        rows = filled.select(*parse_fields(F.split(F.trim("value"), r"\s+"), schema))
    return clean_records(rows)


def read_records(spark: SparkSession, path: str, keep_row_id: bool = True) -> DataFrame:
    """Labelled records of comma or white space separated text without header: a file, a folder or a pattern.

    Delimiter and width are decided for each file, and files of one layout are read together, so a folder may hold
    both kinds; columns that a layout lacks are null. The difficulty column is dropped, labels are normalised, and
    ``row_id`` is added. A missing path is an error of the reader. Large files are read in splits.
    """
    groups = detect_layouts(spark, path)
    if not groups:
        raise ValueError(f"no records in {path}")
    parts = [
        parse_lines(spark.read.text(files), delimiter, record_schema(column_names(width)))
        for (delimiter, width), files in sorted(groups.items())
    ]
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return with_row_id(rows) if keep_row_id else rows


def clean_records(rows: DataFrame) -> DataFrame:
    """Drop the difficulty column and normalise the label."""
    rows = rows.drop(*DIFFICULTY)
    return rows.withColumn("label", normalize_label(F.col("label"))) if "label" in rows.columns else rows


def with_row_id(rows: DataFrame, copies_per_task: int = COPIES_PER_TASK) -> DataFrame:
    """Add a ``row_id`` that depends on the content only: a 128-bit hash of all columns and a copy number.

    Equal rows are interchangeable, so copies are counted by a partial aggregate and written out again by number.
    Rows with copies are written out in chunks that are dealt to a fixed number of tasks: by their bytes, which say
    nothing about the copies, adaptive execution would put them all into one.
    """
    columns = rows.columns
    quoted = [F.col(f"`{name}`") for name in columns]
    counted = rows.groupBy(*quoted).agg(F.count(F.lit(1)).alias("_copies"))
    # hashing skips nulls, so flags tell which column was null, and nested values are hashed in their written form
    nested = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) for f in rows.schema.fields if isinstance(f.dataType, NESTED)]
    content = [*[column.isNull() for column in quoted], *quoted, *nested]
    low = F.hex(F.xxhash64(*content))
    high = F.hex(F.xxhash64(F.lit("row"), *content))
    hashed = counted.withColumn("_hash", F.concat(F.lpad(high, 16, "0"), F.lpad(low, 16, "0")))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / copies_per_task))
    once = hashed.where("_copies = 1").withColumn("_chunk", F.lit(0).cast("long"))
    many = hashed.where("_copies > 1").withColumn("_chunk", F.explode(chunks))
    tasks = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    spread = once.unionByName(many.repartition(tasks, "_hash", "_chunk"))
    first = F.col("_chunk") * copies_per_task + 1
    last = F.least(F.col("_copies"), (F.col("_chunk") + 1) * copies_per_task)
    numbered = spread.withColumn("_copy", F.explode(F.sequence(first, last)))
    return numbered.select(F.concat_ws("-", "_hash", F.col("_copy").cast("string")).alias("row_id"), *quoted)


def spread_scan(rows: DataFrame) -> DataFrame:
    """Spread a plain scan that Spark cannot split (a compressed text file, one row group) over all cores.

    Worth a shuffle before repeated passes such as training; a scan that has enough partitions is left alone.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_client_tables(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All client tables below ``path``: Parquet partitioned by ``client_id``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_client_csv(spark: SparkSession, path: str) -> DataFrame:
    """Client tables kept as CSV with a header: files ``client_<number>.csv``, or folders ``client_id=<number>``.

    All files share the record layout, whose column names are known, so types are not inferred. A column of the
    header with an unknown name is read as text. Having no such file is an error of the reader.
    """
    root = path.rstrip("/")
    files, number = f"{root}/client_*.csv", r"/client_(\d+)\.csv$"
    if any_path(spark, f"{root}/client_id=*"):
        files, number = f"{root}/client_id=*/*.csv", r"/client_id=(\d+)/[^/]*$"
    header = spark.read.csv(files, header=True, enforceSchema=False).limit(0).columns
    rows = spark.read.csv(files, header=True, schema=record_schema(header), enforceSchema=False)
    client = F.regexp_extract(F.col("_metadata.file_path"), number, 1).cast("int")
    return clean_records(rows.withColumn("client_id", client))


def write_client_tables(
    dealt: DataFrame, path: str, drop_family: bool = True, files_per_client: int = 16
) -> None:
    """One partition directory per client, in shuffled order, without the family column unless it is kept.

    Each client is written by up to ``files_per_client`` tasks, so a large client is not one task and a small one
    not thousands of files.
    """
    _by_client(dealt, drop_family, files_per_client).write.mode("errorifexists").partitionBy("client_id").parquet(path)


def write_client_csv(dealt: DataFrame, path: str, drop_family: bool = True, files_per_client: int = 16) -> None:
    """The same as CSV with a header in every file, which ``read_client_csv`` reads back."""
    placed = _by_client(dealt, drop_family, files_per_client)
    placed.write.mode("errorifexists").partitionBy("client_id").csv(path, header=True)


def _by_client(dealt: DataFrame, drop_family: bool, files_per_client: int) -> DataFrame:
    part = F.pmod(F.xxhash64("shuffle_key"), F.lit(files_per_client))
    placed = dealt.repartition("client_id", part).sortWithinPartitions("client_id", "shuffle_key")
    return placed.drop("shuffle_key", *(["family"] if drop_family else []))


def label_profile(rows: DataFrame, label: str = "label", top: int = 10) -> DataFrame:
    """The ``top`` most frequent labels with their counts, ties by name."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), label).limit(top)


def dataset_profile(rows: DataFrame, label: str = "label", top: int = 10) -> dict:
    """Row count, column count and top labels: the report after loading a file."""
    return {
        "rows": rows.count(),
        "columns": len(rows.columns),
        "labels": [(r[label], r["n"]) for r in label_profile(rows, label, top).collect()],
    }
