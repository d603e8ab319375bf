"""Runs queries beside their SQL: python -m tests.oracle [-d FOLDER] [NAME...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def tables(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in sorted(glob.glob(f"{d}/*.parquet")):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{at}'")
    return c


def _value(x: object) -> str:
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(columns: list[str], found: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in found)


def compare(spark, d: str, query, sql: str) -> str:  # noqa: ANN001
    df = query(spark, d)
    got = rows(df.columns, df.collect())
    r = tables(d).execute(sql)
    names = [x[0] for x in r.description]
    want = rows(names, r.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} against {names}"
    if got != want:
        only, other = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} rows against {len(want)}; {sorted(names)}: only here {list(only)[:3]}, only SQL {list(other)[:3]}"
    return ""


def session(cores: int = 8):  # noqa: ANN201
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def main(args: list[str]) -> None:
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        d, args = args[1], args[2:]
    spark = session()
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args or queries:
        t = time.time()
        try:
            said = compare(spark, d, queries[name], sql[name]) if name in sql else f"rows only: {queries[name](spark, d).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
