"""Small tables that every operator of trustframe.llm has to take: nulls, empties, repeats, long texts, clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names that the operators use for columns of their own.
CLASHES = "_id _hash row id hash fp text_hash key words lines removed place doc h score predicted component label".split()
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows() -> list[tuple]:
    texts = [
        (1, "The quick brown fox jumps over the lazy dog again and again today."),
        (2, None),
        (3, ""),
        (4, "   \n\t \n"),
        (5, LONG),
        (5, LONG),  # a repeated row
        (6, LONG + " end"),
        (None, "no id here at all, only words"),
        (None, "no id here at all, only words"),
        (7, "same id, first text"),
        (7, "same id, second text"),
        (8, "The quick brown fox jumps over the lazy dog again and again today."),
        (9, "x"),
        (10, "ÄÖÜ ß 漢字 \x00 \U0001f600 é"),
        (11, "..."),
    ]
    return [(d, t, "en" if i % 3 else None, "s", None if t is None else len(t)) for i, (d, t) in enumerate(texts)]


def odd_documents(spark: SparkSession, extra: bool = True) -> DataFrame:
    frame = spark.createDataFrame(odd_rows(), SCHEMA)
    if extra:
        frame = frame.selectExpr("*", *[f"concat('extra ', doc_id) as `{name}`" for name in CLASHES])
    return frame


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def write_tables(spark: SparkSession, folder: str, **tables: DataFrame) -> str:
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return folder
