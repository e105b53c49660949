"""Run registered queries next to their SQL twins: python tests/check_queries.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def frame_rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        rows.append(tuple("~" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA
                          else (round(float(v), 6) + 0.0 if isinstance(v, float) else v) for v in row))
    return sorted(map(repr, rows))


def compare(spark: SparkSession, connection, sf_dir: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    got = contract.queries()[name](spark, sf_dir).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None if len(got) else "no rows"
    want = connection.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    kinds = [
        f"{c}: {got[c].dtype} != {want[c].dtype}" for c in got.columns if str(got[c].dtype) != str(want[c].dtype)
    ]
    left, right = frame_rows(got), frame_rows(want)
    if left != right:
        pair = next((a, b) for a, b in zip(left, right) if a != b)
        return f"values differ: {pair[0]} / {pair[1]} {kinds}"
    return f"types only: {kinds}" if kinds else None


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main(arguments: list[str]) -> int:
    size, names = (arguments[0] if arguments else "0.01"), arguments[1:]
    sf_dir = f"/root/testdata/sf{size}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle(sf_dir)
    bad = 0
    for name in names or contract.queries():
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on
            problem = "".join(traceback.format_exception_only(error))[:600]
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} differences", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
