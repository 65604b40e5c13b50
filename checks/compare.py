"""Run queries in Spark and their SQL in DuckDB on the same tables and compare.

``python -m checks.compare [folder] [query ...]``
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    got, want = canonical(got), canonical(want)
    kinds = [(c, got[c].dtype, want[c].dtype) for c in got if got[c].dtype != want[c].dtype]
    if kinds and len(got):
        return f"types {kinds}"
    unequal = (got != want).any(axis=1)
    if unequal.any():
        return f"{int(unequal.sum())} rows differ, first {got[unequal].head(1).values.tolist()}"
    return None


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textmine-checks")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(folder: str, names: list[str]) -> int:
    spark, con = session(), connect(folder)
    failed = 0
    for name in names or list(QUERIES):
        start = time.perf_counter()
        got = QUERIES[name](spark, folder).toPandas()
        middle = time.perf_counter()
        found = "no SQL"
        if name in ORACLES:
            found = difference(got, con.execute(ORACLES[name]).df())
        end = time.perf_counter()
        failed += found not in (None, "no SQL")
        print(
            f"{name:32} {found or 'equal':10} rows {len(got):8} "
            f"spark {middle - start:6.2f} sql {end - middle:6.2f}",
            flush=True,
        )
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(main(arguments[0], arguments[1:]))
