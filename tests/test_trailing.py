from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panewright.operators import trailing as t

START = date(2015, 1, 1)


def _run(df, start=START, days=9, periods=(2, 4)):  # noqa: ANN001, ANN202
    out = t.rolling(df, F.col("e"), F.col("d"), F.col("v"), start, start + timedelta(days=days), periods)
    return {(r["entity"], r["day"]): r.asDict() for r in out.collect()}


@pytest.mark.parametrize("name", list(t.MONOIDS))
def test_queue_combines_what_it_holds(name) -> None:  # noqa: ANN001
    rng = np.random.default_rng(3)
    days = rng.integers(-9, 9, (40, 3)).astype(float)
    fold = {"sum": np.sum, "count": np.sum, "min": np.min, "max": np.max}[name]
    for width in (1, 2, 7, 50):
        got = t.trailing(days, t.MONOIDS[name], width)
        assert np.array_equal(got, np.array([fold(days[max(0, i - width + 1) : i + 1], axis=0) for i in range(40)]))


def test_against_brute_force(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(t, "BLOCK_CELLS", 40)
    rng = random.Random(5)
    rows = [(rng.choice([None, "", *"abcdefgh"]), rng.choice([None, *(START + timedelta(days=k) for k in range(-6, 14))]), rng.choice([None, 0, 1, 5, -2])) for _ in range(400)]
    rows += rows[:50]
    got = _run(spark.createDataFrame(rows, "e string, d date, v int").repartition(7))
    entities = {e for e, d, _ in rows if e is not None and d is not None}
    assert set(got) == {(e, START + timedelta(days=k)) for e in entities for k in range(10)}
    for (e, day), r in got.items():
        for p in (2, 4):
            v = [x for f, d, x in rows if f == e and d is not None and day - timedelta(days=p) < d <= day and x is not None]
            assert (r[f"total_{p}d"], r[f"n_{p}d"]) == (sum(v), len(v))
            assert (r[f"least_{p}d"], r[f"most_{p}d"]) == ((min(v), max(v)) if v else (None, None))
            assert r[f"mean_{p}d"] == (pytest.approx(sum(v) / len(v)) if v else None)


def test_empty_null_and_extra_columns(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("a", START, None, 1)], "e string, d date, v int, day int")
    got = _run(df)
    assert len(got) == 10 and {(r["total_4d"], r["n_4d"], r["mean_4d"]) for r in got.values()} == {(0, 0, None)}
    assert _run(df.limit(0)) == {}
    late = spark.createDataFrame([("a", START + timedelta(days=400), 1)], "e string, d date, v int")
    assert len(_run(late)) == 10
    with pytest.raises(ValueError, match="empty"):
        _run(df, days=-1)


def test_fractions(spark) -> None:  # noqa: ANN001
    got = _run(spark.createDataFrame([("a", START, 0.5), ("a", START, 0.25)], "e string, d date, v double"), days=0)
    assert got["a", START]["total_2d"] == 0.75


def test_nan_is_no_value_and_infinities_are(spark) -> None:  # noqa: ANN001
    inf, nan = float("inf"), float("nan")
    rows = [("a", START, nan), ("a", START, 5.0), ("b", START, nan), ("c", START, inf), ("c", START, 1.0)]
    got = _run(spark.createDataFrame(rows, "e string, d date, v double"), days=0)
    said = {e: tuple(got[e, START][f"{c}_2d"] for c in ("total", "n", "mean", "least", "most")) for e in "abc"}
    assert said == {"a": (5.0, 1, 5.0, 5.0, 5.0), "b": (0.0, 0, None, None, None), "c": (inf, 2, inf, 1.0, inf)}


def test_wide_integers_are_exact(spark) -> None:  # noqa: ANN001
    big = 2**62 + 1
    rows = [("a", START, big), ("a", START + timedelta(days=1), -big - 2), ("a", START + timedelta(days=2), None), ("b", START, 2**63 - 1)]
    got = _run(spark.createDataFrame(rows, "e string, d date, v long"), days=2)
    day = got["a", START + timedelta(days=1)]
    assert (day["total_2d"], day["least_2d"], day["most_2d"]) == (-2, -big - 2, big) and got["b", START]["most_4d"] == 2**63 - 1
    over = spark.createDataFrame([("a", START, big), ("a", START + timedelta(days=1), big)], "e string, d date, v long")
    with pytest.raises(Exception, match="64 bits"):
        _run(over, days=1)


def test_twenty_years_in_small_blocks(spark) -> None:  # noqa: ANN001
    """7,300 days of 300 entities: blocks hold BLOCK_CELLS cells, not all entities."""
    df = spark.range(3_000).select((F.col("id") % 300).cast("string").alias("e"), F.date_add(F.lit(START), (F.col("id") * 2).cast("int")).alias("d"), F.lit(1).alias("v"))
    out = t.rolling(df, F.col("e"), F.col("d"), F.col("v"), START, START + timedelta(days=7_299), (7, 365))
    row = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("e"), F.sum("n_7d").alias("seven")).first()
    assert (row["n"], row["e"], row["seven"]) == (300 * 7_300, 300, 7 * 3_000)
