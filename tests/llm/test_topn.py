from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panewright.llm import topn as t
from panewright.sources import scratch_path

GROUPS = ["g", "h"]


def _want(rows, n):  # noqa: ANN001, ANN202
    groups: dict = {}
    for g, h, s, i in rows:
        if s is not None:
            groups.setdefault((g, h), []).append((-s, i))
    return sorted(i for v in groups.values() for _, i in sorted(v)[:n])


def _got(df, n, file_rows=t.FILE_ROWS):  # noqa: ANN001, ANN202
    return sorted(r["i"] for r in t.top_n_of(df, [F.col(g) for g in GROUPS], F.col("s"), F.col("i"), n, file_rows).collect())


@pytest.mark.parametrize(("n", "file_rows"), [(1, 10_000), (3, 150), (50, 40), (10_000, 300)])
def test_against_brute_force(spark, monkeypatch, n, file_rows) -> None:  # noqa: ANN001
    for name, rows in (("SECTION_ROWS", 40), ("ROW_GROUP_ROWS", 5), ("SMALL_GROUP", 3)):
        monkeypatch.setattr(t, name, rows)
    rng = random.Random(n)
    rows = [(rng.choice([None, "", "N", "a", "V1:a", *["hot"] * 8]), rng.choice([None, 1, 11]), rng.choice([None, *range(12)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, h int, s int, i long")
    assert _got(df.withColumn("rank", F.lit("z")), n, file_rows) == _want(rows, n)


def test_hot_group_skips_row_groups(spark) -> None:  # noqa: ANN001
    df = spark.range(400_000).select(F.lit("hot").alias("g"), F.lit(None).cast("int").alias("h"), (F.col("id") % 100_000).alias("s"), F.col("id").alias("i"))
    path = t.cluster(df, [F.col("g"), F.col("h")], F.col("s"), F.col("i"), scratch_path(spark, "topn-test"))
    files = t.manifest(spark, path)
    every, read = files.select(F.explode("row_groups")).count(), t.planned(files, 5).select(F.explode("row_groups")).count()
    assert every >= 4 and files.count() == 8 and read <= 2 and t.skipped(spark, path, 5).first()["read"] <= 2
    assert [(r["s"], r["i"]) for r in t.top_n(spark, path, 5).orderBy("rank").collect()] == [(99_999, 99_999), (99_999, 199_999), (99_999, 299_999), (99_999, 399_999), (99_998, 99_998)]


def test_many_groups_skip_what_is_below_each_ones_nth(spark) -> None:  # noqa: ANN001
    """Row groups hold many groups each; all but the highest are skipped, though groups of two items have to be read whole."""
    many = spark.range(60_000).select((F.col("id") % 300).cast("string").alias("g"), F.lit(1).alias("h"), F.floor(F.col("id") / 300).cast("int").alias("s"), F.col("id").alias("i"))
    few = spark.range(200).select(F.concat(F.lit("x"), F.floor(F.col("id") / 2)).alias("g"), F.lit(1).alias("h"), F.lit(0).alias("s"), (F.col("id") + 60_000).alias("i"))
    df = many.unionByName(few)
    path = t.cluster(df, [F.col("g"), F.col("h")], F.col("s"), F.col("i"), scratch_path(spark, "topn-test"))
    said = t.skipped(spark, path, 3).first()
    assert said["row_groups"] >= 25 and said["read"] <= said["row_groups"] / 3
    assert sorted(r["i"] for r in t.top_n(spark, path, 3).collect()) == [*range(59_100, 60_200)]


def test_sections() -> None:
    counts = np.array([5, 20_000, 9_000, 3, 9_000, 40_000, 17])
    got = t._sections(counts)
    assert got[0] == got[3] == 0 and got[2] == got[4] and len({got[1], got[5], got[0], got[2], got[6]}) == 5


def test_file_systems_by_scheme(monkeypatch) -> None:  # noqa: ANN001
    import types

    from pyarrow import fs

    assert t._file_system("file:///a%20b/c")[1] == "/a b/c" and t._file_system("/a/b")[1] == "/a/b"
    monkeypatch.setattr(fs, "FileSystem", types.SimpleNamespace(from_uri=lambda uri: uri))
    assert t._file_system("s3a://bucket/x/y") == "s3://bucket/x/y" and t._file_system("hdfs://n:1/x") == "hdfs://n:1/x"
    with pytest.raises(ValueError, match="can't be opened"):
        t._file_system("wasb://x/y")


def test_ties_repeats_nulls_and_empty(spark) -> None:  # noqa: ANN001
    rows = [("a", 1, 5, 7), ("a", 1, 5, 7), ("a", 1, 5, 3), (None, None, 0, 9), ("a", None, -4, 8), ("b", 1, None, 1)]
    df = spark.createDataFrame(rows, "g string, h int, s int, i long")
    assert _got(df, 2) == _want(rows, 2) == [3, 7, 8, 9]
    assert _got(df.limit(0), 2) == []
    with pytest.raises(ValueError, match="at least 1"):
        t.top_n(spark, "x", 0)
