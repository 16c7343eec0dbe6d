"""Runs queries beside their SQL on DuckDB: python tests/compare.py [FOLDER] [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value as both engines would write it."""
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return str(value) if value is not None and not isinstance(value, int | bool | str) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, folder: str, name: str, query, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(sql)
    columns, expected = want.columns, want.fetchall()
    df = query(spark, folder)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    got, expected = rows_of(df.columns, df.collect()), rows_of(columns, expected)
    if got == expected:
        return ""
    a, b = set(map(repr, got)), set(map(repr, expected))
    return f"{len(got)} rows against {len(expected)}; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    for n in names or sql:
        t = time.time()
        try:
            print(n, compare(spark, folder, n, queries[n], sql[n]) or "equal", round(time.time() - t, 1), flush=True)
        except Exception as e:
            print(n, "ERROR", str(e)[:600], flush=True)
