from __future__ import annotations

from pyspark.sql import functions as F

from panewright import col, row_number, sum_, window
from panewright.sources import checkpointed, clear_scratch, code, header_csv, scratch_path, shared_folder, spread_table


def test_header_csv(spark, tmp_path) -> None:  # noqa: ANN001
    path = tmp_path / "f.csv"
    path.write_text('Origin,FlightDate,DepDel15\nSAN,2015-03-01,1\n"S,X",bad,\n,,x\n')
    rows = header_csv(spark, str(path), {"FlightDate": "date", "DepDel15": "int"}).collect()
    assert [(r[0], str(r[1]), r[2]) for r in rows] == [("SAN", "2015-03-01", 1), ("S,X", "None", None), (None, "None", None)]


def test_windows_over_csv_written_to_parquet(spark, tmp_path) -> None:  # noqa: ANN001
    spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 9)], "p string, o int, v int").write.option("header", True).csv(str(tmp_path / "in"))
    w = window().partition_by("p").order_by("o")
    df = header_csv(spark, str(tmp_path / "in"), {"o": "int", "v": "int"}).cache()
    df.select("p", "o", sum_("v", "bigint").over(w.running()).col().alias("s"), (row_number().over(w) + col("v")).col().alias("n")).write.parquet(str(tmp_path / "out"))
    df.unpersist()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1, 2, 3), ("a", 2, 5, 5), ("b", 1, 9, 10)]


def test_codes(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(" san ",), ("\tSan",), (None,)], "c string")
    assert [r[0] for r in df.select(code("c")).collect()] == ["SAN", "\tSAN", None]


def test_shared_folder_is_the_sessions(spark) -> None:  # noqa: ANN001
    at = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == at and scratch_path(spark, "x").startswith(at)
    kept = checkpointed(spark.range(3).select(F.col("id") * 2))
    assert "ExistingRDD" in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 3


def test_small_tables_are_spread(spark, tmp_path) -> None:  # noqa: ANN001
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    df = spread_table(spark, str(tmp_path), "t", "id")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == 100


def test_scratch_is_cleared(spark) -> None:  # noqa: ANN001
    clear_scratch(spark)
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    scratch_path(spark, "never-written")
    assert spark.read.parquet(path).count() == 3 and clear_scratch(spark) == 1 and clear_scratch(spark) == 0


def test_a_folder_set_on_the_context_is_used() -> None:
    from types import SimpleNamespace

    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: "hdfs://n/c/uuid", setCheckpointDir=None)
    assert shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d))) == "hdfs://n/c/uuid"
