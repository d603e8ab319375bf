from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panewright.llm import quantiles as q

QS = [0.01, 0.25, 0.5, 0.9, 0.99, 0.999, 0.9999]


def _errors(sketch: q.Sketch, x: np.ndarray) -> None:
    x = np.sort(x)
    for p, v in zip(QS, sketch.quantiles(QS), strict=True):
        low, high = np.searchsorted(x, v, "left") / len(x), np.searchsorted(x, v, "right") / len(x)
        bound = q.rank_error(p) + 1 / len(x)
        assert low - bound <= p <= high + bound, (p, low, high, bound)


@pytest.mark.parametrize("kind", ["normal", "rising", "falling", "few", "heavy"])
def test_rank_error_holds(kind) -> None:  # noqa: ANN001
    rng = np.random.default_rng(1)
    n = 300_000
    x = {"normal": rng.normal(size=n), "rising": np.arange(n, dtype=float), "falling": -np.arange(n, dtype=float), "few": rng.integers(0, 5, n).astype(float), "heavy": rng.pareto(1.0, n)}[kind]
    s = q.Sketch(seed=5)
    s.update(x)
    _errors(s, x)
    assert s.n == n and s.retained() < 6_000
    assert s.quantiles([0.0, 1.0]) == [x.min(), x.max()]


def test_merging_in_any_order_keeps_the_error() -> None:
    rng = np.random.default_rng(2)
    parts = [rng.exponential(size=int(k)) for k in rng.integers(1, 20_000, 40)]
    sketches = []
    for i, p in enumerate(parts):
        s = q.Sketch(seed=i)
        s.update(p)
        sketches.append(q.Sketch.from_bytes(s.to_bytes(), i))
    line, tree = q.Sketch(seed=99), sketches[:]
    for s in sketches:
        line.merge(q.Sketch.from_bytes(s.to_bytes()))
    while len(tree) > 1:
        tree[0].merge(tree.pop())
        tree = tree[1:] + tree[:1]
    x = np.concatenate(parts)
    for s in (line, tree[0]):
        assert s.n == len(x)
        _errors(s, x)
        assert sum(level.n << h for h, level in enumerate(s.levels)) == len(x)


def test_small_groups_are_exact() -> None:
    s = q.Sketch()
    s.update(np.array([3.0, 1.0, 2.0, 2.0]))
    assert s.quantiles([0.25, 0.5, 0.75, 1.0]) == [1.0, 2.0, 2.0, 3.0]
    assert q.Sketch().quantiles([0.5]) == [None]
    assert q.Sketch.from_bytes(q.Sketch().to_bytes()).n == 0


def test_tables(spark, monkeypatch) -> None:  # noqa: ANN001
    rows = [(k, d, float(v) if v % 11 else None) for k in ("a", None, "") for d in (1, 2) for v in range(2_000)] + [("z", 1, None), ("n", 1, float("nan"))]
    df = spark.createDataFrame(rows, "k string, d int, v double").repartition(5)
    monkeypatch.setattr(q, "_HELD", 1)
    daily = q.summaries(df.withColumn("n", F.lit(1)).withColumn("sketch", F.lit("x")), {"k": F.col("k"), "d": F.col("d")}, F.col("v"))
    whole = q.percentiles(q.merge_summaries(daily, ["k"]), ["k"], {"p50": 0.5, "p99": 0.99})
    got = {r["k"]: r for r in whole.collect()}
    assert set(got) == {"a", None, ""}
    for r in got.values():
        assert r["n"] == 2 * sum(v % 11 > 0 for v in range(2_000)) and abs(r["p50"] - 1_000) < 30 and abs(r["p99"] - 1_980) < 4
    assert {(r["k"], r["d"]) for r in daily.collect()} == {(k, d) for k in got for d in (1, 2)}
    assert q.percentiles(q.summaries(df.limit(0), {"k": F.col("k")}, F.col("v")), ["k"], {"p": 0.5}).collect() == []


def test_several_groupings_in_one_pass_and_merging_in_two_steps(spark, monkeypatch) -> None:  # noqa: ANN001
    rows = [(("a", None)[v % 2], v % 3, float(v)) for v in range(3_000)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(6)
    each = {"K": F.col("k"), "J": F.col("j").cast("string")}
    for tree in (1_000, 2):
        monkeypatch.setattr(q, "TREE_FROM", tree)
        found = q.summaries(df, {"half": F.col("v") < 1_500}, F.col("v"), each=each)
        got = {(r["field"], r["code"], r["half"]): r for r in q.percentiles(found, ["field", "code", "half"], {"least": 0.0, "p50": 0.5}).collect()}
        assert {k[:2] for k in got} == {("K", "a"), ("K", None), ("J", "0"), ("J", "1"), ("J", "2")} and len(got) == 10
        assert got["K", None, True]["n"] == 750 and got["K", None, True]["least"] == 1.0 and abs(got["J", "1", False]["p50"] - 2_250) < 40


def test_codes_of_many_columns() -> None:
    rng = np.random.default_rng(4)
    columns = [(rng.integers(0, 3, 500), 1 << 21) for _ in range(4)]
    codes = q._codes(columns, 500)
    tuples = list(zip(*(c for c, _ in columns), strict=True))
    assert len(set(codes.tolist())) == len(set(tuples)) == len(set(zip(codes.tolist(), tuples, strict=True)))
