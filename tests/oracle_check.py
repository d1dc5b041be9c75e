"""Run queries in Spark and DuckDB and compare rows; also a command line.

    python -m tests.oracle_check /root/testdata/sf0.01 [query …]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("emberlog")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="emberlog-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def rows_of(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _sorted_rows(df.columns, [tuple(row) for row in df.collect()])


def oracle_rows(con: duckdb.DuckDBPyConnection, name: str) -> tuple[list[str], list[tuple]]:
    table = con.sql(contract.oracle_sql()[name]).to_arrow_table()
    rows = list(zip(*[column.to_pylist() for column in table.columns], strict=True))
    return sorted(table.column_names), _sorted_rows(table.column_names, rows)


def main(sf_dir: str, chosen: list[str]) -> int:
    spark, con = session(), connect(sf_dir)
    failed = 0
    for name in chosen or contract.queries():
        began = time.perf_counter()
        try:
            columns, rows = rows_of(contract.queries()[name](spark, sf_dir))
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            print(f"{name:34} ERROR {str(error)[:1500]}", flush=True)
            failed += 1
            continue
        took = time.perf_counter() - began
        if name not in contract.oracle_sql():
            verdict = "no oracle"
        else:
            try:
                expected = oracle_rows(con, name)
            except Exception as error:  # noqa: BLE001
                expected = ([], [])
                print(f"{name:34} ORACLE ERROR {str(error)[:800]}", flush=True)
            same = expected == (columns, rows)
            verdict = "ok" if same else "DIFFERENT"
            if not same:
                failed += 1
                print("   columns", columns, expected[0], len(rows), len(expected[1]))
                ours, theirs = set(rows), set(expected[1])
                print("   only spark ", sorted(ours - theirs, key=repr)[:3])
                print("   only oracle", sorted(theirs - ours, key=repr)[:3])
        print(f"{name:34} {verdict:10} {len(rows):7} rows {took:7.2f}s", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
