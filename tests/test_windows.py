"""Frames, functions and rewrites against closed forms, a plain evaluator and each other."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException

from panewright import Frame, Rewrites, agg, asc, avg, count, count_distinct, dense_rank, desc, first, lag, last, lead, max_, min_, rank, row_number, shift, stddev, sum_, window
from panewright.plans.window import OrderKey
from pyspark.sql import functions as F

PLAIN = Rewrites.none()
UNIQUE = Rewrites(unique_order=True, slide_from=2)


@pytest.fixture(scope="module")
def numbers(spark):  # noqa: ANN001, ANN201
    return spark.range(20).select(F.col("id").cast("int").alias("i")).cache()


def values(df, e, use=None) -> list:  # noqa: ANN001
    return [r[1] for r in df.select("i", e.col(use).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("use", [PLAIN, UNIQUE, None])
def test_closed_forms(numbers, use) -> None:  # noqa: ANN001
    w = window().order_by("i")
    s = sum_("i", "bigint")
    assert values(numbers, lead("i").over(w), use) == [*range(1, 20), None]
    assert values(numbers, s.over(w), use) == [190] * 20
    assert values(numbers, s.over(w.rows_preceding(0)), use) == [190 - i * (i - 1) // 2 for i in range(20)]
    assert values(numbers, s.over(w.running()), use) == [i * (i + 1) // 2 for i in range(20)]
    assert values(numbers, s.over(w.rows_preceding(1).rows_following(1)), use) == [1, *(3 * i for i in range(1, 19)), 37]


@pytest.fixture(scope="module")
def groups(spark):  # noqa: ANN001, ANN201
    return spark.range(8).selectExpr("id as i", "id % 2 as p", "id * 10 as v").cache()


def test_two_groups(groups) -> None:  # noqa: ANN001
    w = window().partition_by("p").order_by("i")
    of = lambda e: values(groups.where("p = 0"), e, UNIQUE)
    assert of(sum_("v", "bigint").over(w.rows_preceding(3).rows_following(-1))) == [None, 0, 20, 60]
    assert of(sum_("v", "bigint").over(w.rows_preceding(-2).rows_following(4))) == [100, 60, None, None]
    assert of(count().over(w.rows_preceding(-2).rows_following(4))) == [2, 1, 0, 0]
    assert of(first("v").over(w.rows_preceding(0))) == [0, 20, 40, 60]
    assert of(last("v").over(w.rows_preceding(0))) == [60] * 4
    assert of(count_distinct("v").over(w.rows_preceding(1).rows_following(1))) == [2, 3, 3, 2]
    assert of(sum_("v").over(window().partition_by("p").order_by(desc("i")).values_preceding(2).values_following(0))) == [20, 60, 100, 60]
    assert of(row_number().over(w.running())) == [1, 2, 3, 4]
    assert of(shift("v", 0).over(w)) == [0, 20, 40, 60]
    assert of(lag("v").over(w)) == [None, 0, 20, 40]
    assert of((sum_("v") / count()).over(w.running())) == [0.0, 10.0, 20.0, 30.0]


def test_null_and_gapped_range_keys(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(0, None, 1), (1, None, 2), (2, 1, 4), (3, 2, 8), (4, 5, 16)], "i int, o int, v int")
    w = window().order_by("o")
    for use in (PLAIN, UNIQUE):
        assert values(df, sum_("v").over(w.values_preceding(1).values_following(1)), use) == [3, 3, 12, 12, 16]
        assert values(df, sum_("v").over(w.values_following(1)), use) == [3, 3, 15, 15, 31]
        assert values(df, sum_("v").over(w.values_preceding(1)), use) == [31, 31, 28, 28, 16]


def test_null_partition_is_a_group_and_empty_is_empty(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(0, None, 1), (1, None, 2), (2, 1, 3)], "i int, p int, v int")
    assert values(df, sum_("v").over(window().partition_by("p"))) == [3, 3, 3]
    assert values(df.limit(0), sum_("v").over(window().partition_by("p"))) == []


def test_ranks_on_ties(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "i int, o int")
    w = window().order_by("o")
    assert values(df, rank().over(w)) == [1, 1, 3]
    assert values(df, dense_rank().over(w)) == [1, 1, 2]
    assert dict(df.select(rank().over(w).col().alias("r")).dtypes) == {"r": "bigint"}


def _frame(rows: list, frame: Frame, i: int) -> list:
    low = 0 if frame.low is None else max(0, i + frame.low)
    high = len(rows) - 1 if frame.high is None else min(len(rows) - 1, i + frame.high)
    return rows[low : max(high + 1, 0)]


bound = st.one_of(st.none(), st.integers(-4, 4))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture], derandomize=True)
@given(low=bound, high=bound, seed=st.integers(0, 5))
def test_random_frames(spark, low, high, seed) -> None:  # noqa: ANN001
    """Every rewrite on and off against a plain evaluator, with null values and keys, single rows and frames wider than the group."""
    frame = Frame("rows", low, high)
    if frame.inverted:
        return
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice([None, None, *range(9)])) for i in range(25)] + [(25, 3, 7)]
    df = spark.createDataFrame(rows, "i int, p int, v int")
    w = window().partition_by("p").order_by("i")
    w = type(w)(w.partition, w.order, frame)
    want = {"s": {}, "n": {}, "lo": {}, "f": {}}
    for p in (None, 1, 2, 3):
        group = [r for r in rows if r[1] == p]
        for k, r in enumerate(group):
            held = [x[2] for x in _frame(group, frame, k)]
            known = [x for x in held if x is not None]
            want["s"][r[0]] = sum(known) if known else None
            want["n"][r[0]] = len(known)
            want["lo"][r[0]] = min(known) if known else None
            want["f"][r[0]] = held[0] if held else None
    es = {"s": sum_("v", "bigint").over(w), "n": count("v").over(w), "lo": min_("v").over(w), "f": first("v").over(w)}
    for use in (PLAIN, UNIQUE):
        got = df.select("i", *(e.col(use).alias(k) for k, e in es.items())).collect()
        for r in got:
            assert {k: r[k] for k in es} == {k: want[k][r["i"]] for k in es}, (frame, use, r)


def test_rewrites_keep_types(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(0, 5), (1, None)], "i int, v int").withColumn("m", F.col("v").cast("decimal(18,2)"))
    w = window().order_by("i")
    for e in (sum_("m", "decimal(28,2)").over(w.rows_preceding(0)), sum_("v", "bigint").over(w.shifted(1)), avg("v", "double").over(w.shifted(1)), max_("m").over(w.rows_preceding(-1))):
        plain, rewritten = (df.select(e.col(use).alias("v")) for use in (PLAIN, UNIQUE))
        assert plain.dtypes == rewritten.dtypes and sorted(map(str, plain.collect())) == sorted(map(str, rewritten.collect()))


def test_following_frames_become_running_ones(numbers) -> None:  # noqa: ANN001
    plan = lambda e, use: numbers.select(e.col(use).alias("v"))._jdf.queryExecution().executedPlan().toString().lower()
    e = sum_("i", "bigint").over(window().order_by("i").rows_preceding(0))
    assert "currentrow$(), unboundedfollowing" in plan(e, PLAIN)
    assert "currentrow$(), unboundedfollowing" not in plan(e, None)
    tied = min_("i").over(window().order_by("i").rows_preceding(0))
    assert "currentrow$(), unboundedfollowing" in plan(tied, None)  # ROWS ties: only under unique_order
    assert "currentrow$(), unboundedfollowing" not in plan(tied, UNIQUE)


def test_errors(groups) -> None:  # noqa: ANN001
    w = window().partition_by("p").order_by("i")
    for bad in (w.rows_preceding(-2).rows_following(1), window().values_preceding(1).values_following(0), window().order_by("i", "v").values_preceding(1).values_following(0)):
        with pytest.raises(ValueError):
            sum_("v").over(bad).col(PLAIN)
    empty = sum_("v", "bigint").over(w.rows_preceding(-2).rows_following(1)).col(Rewrites(empty_as_null=True))
    assert groups.select(empty.alias("v")).distinct().collect() == [(None,)]
    with pytest.raises(AnalysisException, match="UNSUPPORTED_EXPR_FOR_WINDOW"):
        groups.select(agg(lambda c: c + 1, "v").over(w).col()).collect()


def test_directed_keys_and_composites(groups) -> None:  # noqa: ANN001
    w = window().partition_by("p").order_by(F.col("i").desc())
    assert values(groups.where("p = 1"), sum_("v").over(w.running())) == [160, 150, 120, 70]
    assert values(groups.where("p = 1"), stddev("v").over(w).is_null()) == [False] * 4
    assert values(groups.where("p = 1"), row_number().over(window().partition_by("p").order_by(asc("i")))) == [1, 2, 3, 4]


def test_one_shuffle_for_many_frames(groups) -> None:  # noqa: ANN001
    w = window().partition_by("p").order_by("i")
    df = groups.select(*(e.col().alias(f"c{k}") for k, e in enumerate((sum_("v").over(w), sum_("v").over(w.running()), lead("v").over(w), row_number().over(w)))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1


def test_directed_columns_are_taken_apart(spark, groups) -> None:  # noqa: ANN001
    for given, want in ((F.desc("i"), (False, False)), (F.col("i").asc_nulls_last(), (True, False)), (F.desc_nulls_first(F.col("i") + 1), (False, True)), (F.asc("i"), (True, True))):
        key = window().order_by(given).order[0]
        assert (key.ascending, key.nulls_first, key.opaque) == (*want, False)
    e = min_("v").over(window().partition_by("p").order_by(F.desc("i")).rows_preceding(0))
    plan = groups.select(e.col(UNIQUE).alias("x"))._jdf.queryExecution().executedPlan().toString().lower()
    assert "currentrow$(), unboundedfollowing" not in plan
    assert values(groups, e, UNIQUE) == values(groups, e, PLAIN) == [0, 10, 0, 10, 0, 10, 0, 10]
    assert window().order_by(OrderKey(F.col("i").desc(), opaque=True)).reversible is False


def test_edits_reach_arguments(groups) -> None:  # noqa: ANN001
    w = window().partition_by("p").order_by("i")
    layered = max_(sum_("v", "bigint").running() * -1).over(w)
    assert values(groups, layered) == [0, -10] * 4
    assert values(groups, lag(sum_("v", "bigint").over(w.running())).over(w)) == [None, None, 0, 10, 20, 40, 60, 90]
    inner = sum_("v", "bigint").over(w.rows_preceding(0))
    plan = groups.select(max_(inner).over(w).col(PLAIN).alias("x"))._jdf.queryExecution().executedPlan().toString().lower()
    assert "currentrow$(), unboundedfollowing" in plan  # the caller's rewrites hold inside too


def test_operators(groups) -> None:  # noqa: ANN001
    n = row_number().over(window().partition_by("p").order_by("i"))
    assert values(groups, ~(n == 1)) == [False, False, *[True] * 6]
    assert values(groups, -n) == [-1, -1, -2, -2, -3, -3, -4, -4]
    assert values(groups, n.isin(1, 4)) == [True, True, *[False] * 4, True, True]
    assert values(groups, n.between(2, n)) == [False, False, *[True] * 6]
    assert values(groups, lag("v").over(window().order_by("i")).is_not_null()) == [False, *[True] * 7]


def test_distinct_counts_over_open_frames(spark) -> None:  # noqa: ANN001
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1]), rng.choice([None, *range(4)]), rng.randrange(12)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, p int, v int, o int").repartition(3)
    unique, tied = window().partition_by("p").order_by(desc("o"), "i"), window().partition_by("p").order_by("o")
    for w in (unique, unique.running(), unique.rows_following(-2), unique.rows_preceding(0), unique.rows_preceding(-3), unique.rows_preceding(2).rows_following(1), tied.values_following(1), tied.values_preceding(2), window().partition_by("p")):
        assert values(df, count_distinct("v").over(w), UNIQUE) == values(df, count_distinct("v").over(w), PLAIN)
    assert values(df.where("i < 1"), count_distinct("v").over(unique.rows_preceding(-3)), PLAIN) == [0]
    assert values(df.where("i < 2"), count_distinct("v").over(unique.rows_preceding(-2).rows_following(1)), Rewrites(empty_as_null=True)) == [0, 0]
    plan = df.select(count_distinct("v").over(unique.rows_preceding(0)).col(UNIQUE).alias("x"))._jdf.queryExecution().executedPlan().toString().lower()
    assert "collect_set" not in plan and "currentrow$(), unboundedfollowing" not in plan and plan.count("exchange hashpartitioning") == 2


def test_differences_do_not_overflow(spark) -> None:  # noqa: ANN001
    big = 2**62
    df = spark.createDataFrame([(0, big), (1, big), (2, 5), (3, None), (4, -7)], "i int, v long")
    w = window().order_by("i")
    for frame in (w.rows_preceding(-2), w.rows_preceding(-1).rows_following(2), w.rows_preceding(-4), w.values_preceding(-1).values_following(2)):
        e = sum_("v", "bigint").over(frame)
        assert values(df, e, UNIQUE) == values(df, e, PLAIN)
    wide = df.select("i", F.col("v").cast("decimal(38,0)").alias("v"))
    plan = wide.select(sum_("v", "decimal(38,0)").over(w.rows_preceding(0)).col().alias("x"))._jdf.queryExecution().executedPlan().toString().lower()
    assert "currentrow$(), unboundedfollowing" in plan  # such a sum has no room, so its prefixes might not fit


@pytest.mark.parametrize("key", [asc("o"), desc("o"), asc("o", nulls_first=False), desc("o", nulls_first=True)])
@pytest.mark.parametrize(("low", "high"), [(-2, 2), (-3, -1), (1, 4), (0, 2), (-1, 0)])
def test_sliding_ranges_by_differences(spark, key, low, high) -> None:  # noqa: ANN001
    rng = random.Random(low * 10 + high)
    rows = [(i, rng.choice([None, 1]), rng.choice([None, *range(-9, 9)]), rng.choice([None, *range(20)])) for i in range(70)]
    df = spark.createDataFrame(rows, "i int, p int, v int, o int")
    w = window().partition_by("p").order_by(key).values_preceding(-low).values_following(high)
    for e in (sum_("v", "bigint").over(w), count("v").over(w)):
        plan = df.select(e.col().alias("x"))._jdf.queryExecution().executedPlan().toString().lower()
        assert f"rangeframe, {low}, {high}" not in plan
        assert values(df, e) == values(df, e, PLAIN)
