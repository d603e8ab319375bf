from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from panewright.operators.skew import heavy_keys, per_key


def test_states_and_null_key(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 4), ("b", None), ("", 2)], "k string, v int")
    rows = {r["k"]: r.asDict() for r in per_key(df, {"k": F.col("k")}, {"v": F.col("v")}).collect()}
    assert rows["a"] == {"k": "a", "n_rows": 2, "v_n": 2, "v_sum": 2, "v_mean": 1.0, "v_min": 1, "v_max": 1}
    assert rows["b"]["v_n"] == 0 and rows["b"]["v_sum"] is None
    assert rows[None]["v_sum"] == 4 and rows[""]["n_rows"] == 1


def test_heavy_keys_count_null_rows_but_name_no_null(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("a",)] * 5 + [(None,)] * 85 + [(f"x{i}",) for i in range(10)], "k string")
    assert [tuple(r) for r in heavy_keys(df, F.col("k"), Fraction(1, 20)).collect()] == [("a", 5)]
    assert heavy_keys(df.limit(0), F.col("k"), Fraction(1, 20)).collect() == []


def test_clashing_and_extra_columns(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("a", 1, 2)], "k string, n_rows int, __k0 int")
    assert [tuple(r) for r in heavy_keys(df, F.col("k"), Fraction(1), "n").collect()] == [("a", 1)]


def test_rows_are_combined_before_the_shuffle(spark) -> None:  # noqa: ANN001
    plan = per_key(spark.range(10), {"k": F.col("id") % 2}, {"v": F.col("id")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1 and "partial_sum" in plan
