from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from panewright.streaming import running


def test_running_totals_go_on_over_batches(spark, tmp_path) -> None:  # noqa: ANN001
    schema = "k string, o int, v int"
    batches = [[("a", 2, 5), ("a", 1, 7), (None, 1, None)], [("a", 0, 1), (None, 2, 3), ("b", 1, None)], [("a", 9, None)]]
    source = tmp_path / "in"
    source.mkdir()
    query = running(spark.readStream.schema(schema).parquet(str(source)), ["k"], ["o"], "v").writeStream.format("memory").queryName("running_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
        got = sorted((str(r["k"]), r["n"], r["o"], r["total"], r["least"], r["most"], r["before"]) for r in spark.table("running_out").collect())
    finally:
        query.stop()
    assert got == [
        ("None", 1, 1, None, None, None, None), ("None", 2, 2, 3, 3, 3, None), ("a", 1, 1, 7, 7, 7, None), ("a", 2, 2, 12, 5, 7, 7), ("a", 3, 0, 13, 1, 7, 5),
        ("a", 4, 9, 13, 1, 7, 1), ("b", 1, 1, None, None, None, None),
    ]


@pytest.mark.parametrize(("kind", "values", "want"), [("bigint", [2**60 + 1, None, 2**61], 2**60 + 1 + 2**61), ("decimal(18,2)", [Decimal("0.10"), None, Decimal("0.20")], Decimal("0.30")), ("double", [0.5, float("nan"), 1.0], 1.5)])
def test_totals_are_exact_in_their_type(spark, tmp_path, kind, values, want) -> None:  # noqa: ANN001
    schema = f"k string, o int, v {kind}"
    source = tmp_path / "in"
    name = f"totals_{kind[:3]}"
    spark.createDataFrame([], schema).write.parquet(str(source))
    query = running(spark.readStream.schema(schema).parquet(str(source)), ["k"], ["o"], "v").writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        for i, v in enumerate(values):
            spark.createDataFrame([("a", i, v)], schema).write.mode("append").parquet(str(source))
            query.processAllAvailable()
        rows = spark.table(name).orderBy("n").collect()
    finally:
        query.stop()
    assert [r["n"] for r in rows] == [1, 2, 3] and rows[-1]["total"] == want and rows[1]["total"] == values[0] == rows[1]["before"] and rows[2]["before"] is None


def test_clashing_columns(spark) -> None:  # noqa: ANN001
    with pytest.raises(ValueError, match="already"):
        running(spark.range(1).withColumn("n", F.lit(1)), ["id"], ["id"], "id")
