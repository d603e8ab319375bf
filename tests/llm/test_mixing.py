from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panewright.llm import mixing as m


@pytest.mark.parametrize("seed", range(4))
def test_flight_keeps_both_totals(seed) -> None:  # noqa: ANN001
    rng = np.random.default_rng(seed)
    size = rng.pareto(1.2, 3_000).round() * 10
    p = np.full(len(size), 0.37) if seed else rng.random(len(size))
    out = m.fly(p, size, seed)
    left = (out > 0) & (out < 1)
    assert left.sum() <= 2 and np.isclose(out.sum(), p.sum()) and np.isclose((out * size).sum(), (p * size).sum())
    landed = m.land(out, size)
    assert set(landed) <= {0.0, 1.0}
    assert abs((landed * size).sum() - (p * size).sum()) <= size[left].sum()


def test_probabilities_are_right_on_average() -> None:
    size = np.array([1.0, 5.0, 2.0, 9.0, 4.0, 4.0])
    p = np.array([0.2, 0.5, 0.5, 0.3, 0.9, 0.6])
    mean = np.mean([np.random.default_rng(k).random(6) < m.fly(p, size, k) for k in range(4_000)], axis=0)
    assert np.allclose(mean, p, atol=0.03)


def test_degenerate_sizes() -> None:
    assert sorted(m.land(m.fly(np.full(4, 0.5), np.zeros(4), 1), np.zeros(4))) == [0, 0, 1, 1]
    assert m.fly(np.zeros(0), np.zeros(0), 1).size == 0
    assert m.fly(np.array([0.0, 1.0]), np.array([3.0, 4.0]), 1).tolist() == [0.0, 1.0]


def _tables(spark):  # noqa: ANN001, ANN202
    rows = [(i, "big" if i < 3_000 else "small" if i < 3_050 else None, (i * 37) % 101) for i in range(3_100)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    return sizes, targets


@pytest.mark.parametrize("block", [10_000, 400, 90])
def test_shares_over_blocks_of_any_size(spark, block) -> None:  # noqa: ANN001
    sizes, targets = _tables(spark)
    planned = m.plans(sizes, targets, 20_000)
    mixture = m.mix(sizes, planned, block=block)
    by = {r["source"]: r for r in m.shares(mixture, planned).collect()}
    assert (by["big"]["status"], by["big"]["reached_tokens"]) == ("met", 10_000)
    assert by["small"]["status"] == "short" and by["small"]["reached_tokens"] == 3 * by["small"]["available_tokens"] or by["small"]["reached_tokens"] == 8_000
    assert (by["none"]["status"], by["none"]["copies"]) == ("no_documents", 0)
    most = {r["source"]: r["m"] for r in mixture.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["big"] == 1 and most["small"] <= 3 and None not in most
    assert mixture.groupBy("doc_id").count().where("count > 1").count() == 0
    assert sum(r["reached_share"] for r in by.values()) == pytest.approx(1)


@pytest.mark.parametrize("seed", range(20))
def test_a_huge_document_is_made_up_for(seed) -> None:  # noqa: ANN001
    rng = np.random.default_rng(seed)
    size = np.concatenate([rng.integers(50, 500, 400), [50_000]]).astype(float)
    p = np.full(len(size), 0.6)
    want = float((p * size).sum())
    copies = m.decide(p, size, 0, 1, want, seed)
    assert set(copies) <= {0, 1} and abs((copies * size).sum() - want) <= 1


def test_huge_documents_are_drawn_as_often_as_planned() -> None:
    size = np.concatenate([np.full(300, 100.0), [10_000.0]])
    drawn = [m.decide(np.full(301, 0.6), size, 0, 1, 0.6 * size.sum(), k)[-1] for k in range(400)]
    assert np.mean(drawn) == pytest.approx(0.6, abs=0.08)


def test_exchange_keeps_the_number_where_it_can() -> None:
    size = np.array([10.0, 11, 12, 13, 100])
    out = m.exchanged(np.array([1, 0, 1, 0, 0]), size, 24.0, np.zeros(5), np.ones(5))
    assert (out * size).sum() == 24 and out.sum() == 2
    assert m.exchanged(np.array([1, 1]), np.array([5.0, 5.0]), 10.0, np.zeros(2), np.ones(2)).tolist() == [1, 1]
    assert m.exchanged(np.zeros(0, dtype=int), np.zeros(0), 3.0, np.zeros(0), np.zeros(0)).tolist() == []


def test_few_documents_use_their_repeats() -> None:
    size = np.array([10.0, 100.0])
    assert abs((m.decide(np.full(2, 0.5), size, 1, 5, 34.0, 1) * size).sum() - 34) <= 5


def test_outliers_of_a_source_in_blocks(spark) -> None:  # noqa: ANN001
    rows = [(i, "s", 40_000 if i < 5 else (i * 37) % 101 + 1) for i in range(5_000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    planned = m.plans(sizes, spark.createDataFrame([("s", 0.45, 1)], "source string, target_share double, max_repeats int"))
    for seed in range(3):
        row = m.shares(m.mix(sizes, planned, seed, block=700), planned).first()
        assert row["status"] == "met" and abs(row["deviation"]) < 1e-4, row


def test_status_is_measured() -> None:
    plan = m.Plan("s", 0.5, 2, 10, 1_000, 500.0, 0.5, 10)
    assert [plan.status(t, 10) for t in (500, 505, 480, 600)] == ["met", "met", "missed", "missed"]
    assert m.Plan("s", 0.5, 2, 10, 100, 500.0, 2.0, 10).status(200, 10) == "short"


def test_same_result_again(spark) -> None:  # noqa: ANN001
    sizes, targets = _tables(spark)
    planned = m.plans(sizes, targets, 20_000)
    runs = [sorted(tuple(r) for r in m.mix(sizes.repartition(k), planned, block=300).collect()) for k in (3, 5)]
    assert runs[0] == runs[1]


def test_empty(spark) -> None:  # noqa: ANN001
    sizes, targets = _tables(spark)
    planned = m.plans(sizes.limit(0), targets)
    assert m.mix(sizes.limit(0), planned).collect() == []
    assert {r["status"] for r in m.shares(m.mix(sizes.limit(0), planned), planned).collect()} == {"no_documents"}
    twice = targets.unionByName(targets)
    with pytest.raises(ValueError, match="more than one"):
        m.plans(sizes, twice)
