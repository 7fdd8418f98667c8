"""Run registered queries on Spark and their SQL on DuckDB and compare all rows.

As a script: ``python tests/compare.py [sf] [query ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def make_session(name: str = "trustframe", cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return repr([_canonical(v) for v in value])
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_canonical(row[i]) for i in order) for row in rows)


def compare(spark, connection, query, sql, sf_dir):
    """Return (rows, message); the message is empty when everything agrees."""
    frame = query(spark, sf_dir)
    got_columns, got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return len(got), ""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want_columns, want = _rows(names, cursor.fetchall())
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
             "TIMESTAMP": "timestamp_ntz"}
    odd = [
        f"{name}: {kind} / {types[name]}"
        for name, kind in frame.dtypes
        if name in types and kinds.get(types[name], types[name]) != kind
    ]
    if got_columns != want_columns:
        return len(got), f"columns {got_columns} / {want_columns}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} / {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return len(got), f"{len(wrong)} rows differ, first {wrong[0]}"
    if odd:
        return len(got), f"types differ: {odd}"
    return len(got), ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    chosen = sys.argv[2:] or list(queries())
    sf_dir = f"/root/testdata/{sf}"
    spark = make_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            rows, message = compare(spark, connection, queries()[name], oracle_sql().get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            rows, message = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        status = "FAIL" if message else ("ok" if name in oracle_sql() else "rows")
        bad += bool(message)
        print(f"{status:5} {name:24} {rows:8} rows {time.time() - start:6.2f}s {message}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
