"""Run registered queries on Spark and their SQL on DuckDB, and compare.

Usage: ``python -m checks.compare FOLDER [NAME ...]``
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import oracle_sql
from checks.queries import queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    return sorted((tuple(_value(v) for v in row) for row in rows), key=repr)


def _value(value):
    if value is None or value is pd.NA:
        return None
    if isinstance(value, bool) or str(type(value)) == "<class 'numpy.bool_'>":
        return bool(value)
    if isinstance(value, str):
        return value
    number = float(value)
    return number + 0.0 if number != int(number) or abs(number) > 2**53 else int(number)


def differences(spark_rows: DataFrame, sql_rows: pd.DataFrame) -> list[str]:
    """What differs between both results; empty when they are equal."""
    left = spark_rows.toPandas()
    if sorted(left.columns) != sorted(sql_rows.columns):
        return [f"columns {sorted(left.columns)} and {sorted(sql_rows.columns)}"]
    ours, theirs = canonical(left), canonical(sql_rows)
    if ours == theirs:
        return []
    only_ours, only_theirs = set(ours) - set(theirs), set(theirs) - set(ours)
    return [
        f"rows {len(ours)} and {len(theirs)}; only Spark {len(only_ours)}, only SQL {len(only_theirs)}",
        f"columns {sorted(left.columns)}",
        *[f"Spark {row}" for row in sorted(only_ours, key=repr)[:3]],
        *[f"SQL   {row}" for row in sorted(only_theirs, key=repr)[:3]],
    ]


def main(folder: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql, failed = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            found = differences(query(spark, folder), connection.execute(sql[name]).df())
        except Exception as error:  # noqa: BLE001 - report and go on
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        print("FAIL" if found else "ok  ", name, round(time.time() - started, 1), flush=True)
        for line in found:
            print("      ", line, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
