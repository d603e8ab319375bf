from __future__ import annotations

import random
from datetime import date, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from panewright import asc, avg, count, count_distinct, dense_rank, desc, first, lag, last, lead, max_, min_, ntile, rank, row_number, sum_, window
from panewright.operators.spread_windows import _positions, spread
from panewright.plans.rewrite import Rewrites


def _rows(n: int = 600):  # noqa: ANN202
    rng = random.Random(8)
    start = date(2015, 1, 1)
    return [(i, rng.choice([None, "hot", "hot", "hot", "a", "b"]), rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), start + timedelta(days=rng.randrange(30))) for i in range(n)]


def _columns(w):  # noqa: ANN001, ANN202
    return {
        "total": sum_("v", "bigint").over(w), "so_far": sum_("v", "bigint").over(w.running()), "left": sum_("v", "bigint").over(w.rows_preceding(0)), "n": count("v").over(w.running()),
        "n_left": count().over(w.rows_preceding(0)), "lo": min_("v").over(w.running()), "hi": max_("v").over(w.rows_preceding(0)), "k": row_number().over(w),
        "past3": sum_("v", "bigint").over(w.rows_preceding(3).rows_following(-1)), "around": max_("v").over(w.rows_preceding(2).rows_following(5)), "wide": count("v").over(w.rows_preceding(40).rows_following(9)),
        "before5": sum_("v", "bigint").over(w.rows_following(-5)), "until4": count("v").over(w.rows_following(4)), "from3": min_("v").over(w.rows_preceding(-3)), "back2": sum_("v", "bigint").over(w.rows_preceding(2)),
        "next": lead("v").over(w), "far": lag("v", 30).over(w), "mean": avg("v").over(w), "f": first("i").over(w), "l": last("i").over(w.rows_preceding(1).rows_following(1)),
        "kinds": count_distinct("v").over(w), "near_kinds": count_distinct("v").over(w.rows_preceding(4).rows_following(0)),
    }


@pytest.mark.parametrize("lead_key", [asc("o"), desc("o"), asc("o", nulls_first=False), desc("o", nulls_first=True), asc("d"), asc("s"), asc("i")])
def test_same_as_plain_windows(spark, lead_key) -> None:  # noqa: ANN001
    df = spark.createDataFrame(_rows(), "i long, p string, o int, v int, d date").withColumn("s", F.concat(F.lit("x"), "o")).repartition(4)
    w = window().partition_by("p").order_by(lead_key, "i")
    columns = _columns(w)
    want = df.select("*", *(e.col(Rewrites.none()).alias(n) for n, e in columns.items()))
    got = spread(df, w, columns, Fraction(1, 10), 23)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_without_partition_keys(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame(_rows(), "i long, p string, o int, v int, d date").repartition(4)
    w = window().order_by(desc("o"), "i")
    columns = _columns(w)
    want = df.select("*", *(e.col(Rewrites.none()).alias(n) for n, e in columns.items()))
    assert sorted(map(str, spread(df, w, columns, block_rows=50).collect())) == sorted(map(str, want.collect()))
    assert spread(df.limit(0), w, columns).collect() == []


@pytest.mark.parametrize("keys", [("p",), ()])
def test_ranks_with_peers_over_several_blocks(spark, keys) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(i, "a" if i % 3 else None, i // 97 if i > 300 else None) for i in range(900)], "i long, p string, o int").repartition(3)
    w = window().partition_by(*keys).order_by("o")
    columns = {"r": rank().over(w), "d": dense_rank().over(w)}
    want = df.select("*", *(e.col().alias(n) for n, e in columns.items()))
    assert sorted(map(str, spread(df, w, columns, Fraction(1, 10), 40).collect())) == sorted(map(str, want.collect()))


def test_hot_partitions_are_cut(spark) -> None:  # noqa: ANN001
    df = spark.range(4_000).select(F.lit("x").alias("p"), F.col("id").alias("i"), F.lit(7).alias("tied"))
    w = window().partition_by("p").order_by("tied", "i")
    placed = _positions(df.withColumn("__k0", F.col("p")), ["__k0"], [F.col("tied").asc(), F.col("i").asc()], 8)
    assert [tuple(r) for r in placed.select("i", "__r").where("i <> __r").collect()] == [] and placed.count() == 4_000
    sizes = placed.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 1_000
    out = spread(df, w, {"k": row_number().over(w)}, Fraction(1, 10), 500)
    assert out.where("k = i + 1").count() == 4_000


def test_what_cannot_be_spread(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame(_rows(5), "i long, p string, o int, v int, d date")
    w = window().partition_by("p").order_by("i")
    for bad in (avg("v").over(w.running()), ntile(3).over(w), sum_("v").over(w.values_preceding(1).values_following(1)), sum_("v") + 1, sum_("v").over(w.rows_preceding(-2).rows_following(1))):
        with pytest.raises(ValueError, match="spread|after its end"):
            spread(df, w, {"x": bad})
    with pytest.raises(ValueError, match="already"):
        spread(df, w, {"v": row_number().over(w)})
    with pytest.raises(ValueError, match="begin with __"):
        spread(df.withColumn("__r", F.lit(1)), w, {"x": row_number()})
    with pytest.raises(ValueError, match="order"):
        spread(df, window().partition_by("i"), {"x": row_number()})
