from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from panewright.operators import timestamps as ts
from panewright.queries.data import CONVENTIONS
from tests.brute_times import read

ZONES = [None, "America/New_York", "America/Havana", "America/Asuncion", "America/St_Johns", "Australia/Lord_Howe"]


def _normalise(spark, rows, rules=CONVENTIONS, per_range=50_000):  # noqa: ANN001, ANN202
    df = spark.createDataFrame(rows, "id int, src string, day string, a string, b string, z string")
    return ts.normalise(df, "id", F.col("src"), "day", ("a", "b"), "z", rules, per_range)


def _values() -> list[tuple]:
    dates = ["2015-03-08", "03/08/15", "8.3.2015", "20150308", "8-MAR-2015", "Mar 8, 2015", "Sunday, March 8, 2015", "2015-02-30", "00/00/2015", "NA", "", None, "soon", "2015-11-01", "11/1/2015", "2015-10-04", "8-Foo-2015"]
    times = ["0230", "230", "7", "2400", "2460", "24:00", "02:30", "2:30 AM", "02h30", "12:05am", "13:00 PM", "0:30 pm", "01:30:59", "25:61", " 0130 ", "NA", "", None, "--:--", "0130Z", "0130 -0330", "01:30+05:30", "01:30 EST", "1:30 PM HST", "0130 America/Denver", "01:30 Mars/Base", "01:30 XYZ",
             "1426191667", "1426191667252", "1426191667252123", "14261916672", "20150308023000", "20150308T023000Z", "20151301T000000Z", "2015-03-08T02:30:01.9", "2015-03-08T02:30:01.123456789-07:00", "2015-03-08 02:30 CST", "2015-11-01T01:30:00[America/Denver]",
             "03/08/2015 2:30 AM", "08.03.2015 02:30:15", "Sun, 08 Mar 2015 02:30:00 -0500", "Mar 8 2015 2:30AM", "2015-03-08", "01:30 -2500", "00:00", "2015-03-22T23:30:00", "Q: 01:30", "01:30|02", "é1:30"]
    return list(itertools.product(dates, times))


def test_against_a_plain_reader(spark) -> None:  # noqa: ANN001
    cases = [(d, v, ZONES[i % len(ZONES)]) for i, (d, v) in enumerate(_values())]
    rows = [(i, "s", d, v, None, z) for i, (d, v, z) in enumerate(cases)]
    got = {r["id"]: r["moment"] if r["status"] == "ok" else r["status"] for r in _normalise(spark, rows).where("field = 'a'").collect()}
    wrong = [(c, got[i], read(c[1], c[0], c[2])) for i, c in enumerate(cases) if got[i] != read(c[1], c[0], c[2])]
    assert wrong == []


def test_session_zone_does_not_matter(spark) -> None:  # noqa: ANN001
    rows = [(1, "s", "2015-03-08", "03:30", "2015-01-01T00:00:00Z", "America/New_York")]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = sorted((r["field"], r["moment"]) for r in _normalise(spark, rows).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [("a", "2015-03-08T07:30:00.000000Z"), ("b", "2015-01-01T00:00:00.000000Z")]


def _brute(states, rules):  # noqa: ANN001, ANN202
    cost = lambda path: sum(ts._costs([a], [b], rules)[0, 0] for a, b in itertools.pairwise(path))
    return min(cost(p) for p in itertools.product(*states)), cost


def test_best_path_is_cheapest() -> None:
    rng = random.Random(2)
    for _ in range(60):
        states = [[(rng.choice("xyz"), rng.choice([None, *range(0, 9 * ts.DAY_US, ts.DAY_US)])) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 6))]
        least, cost = _brute(states, CONVENTIONS)
        path = ts.best_path(states, CONVENTIONS)
        assert cost([s[k] for s, k in zip(states, path, strict=True)]) == pytest.approx(least)


@pytest.mark.parametrize("chunk", [50_000, 3])
@pytest.mark.parametrize("per_range", [1_000, 7, 2])
def test_ambiguous_dates_are_settled_by_order_over_any_ranges(spark, monkeypatch, per_range, chunk) -> None:  # noqa: ANN001
    """Day-first messages of one source, month-first ones of another: ranges and chunks of any size give the cheapest whole path."""
    monkeypatch.setattr(ts, "CHUNK", chunk)
    rules = ts.Conventions()
    rows = []
    for i in range(12):
        rows.append((i, "p", None, f"{3 + i:02d}/02/2015 10:00", None, "UTC"))
        rows.append((100 + i, "q", None, f"02/{3 + i:02d}/2015 10:00", None, "UTC"))
    out = _normalise(spark, rows, rules, per_range).where("field = 'a'").collect()
    got = {r["id"]: r["moment"][:10] for r in out}
    assert got == {i: f"2015-02-{3 + i:02d}" for i in range(12)} | {100 + i: f"2015-02-{3 + i:02d}" for i in range(12)}
    assert {r["n_interpretations"] for r in out} == {1, 2}


def test_empty_repeated_and_null_rows(spark) -> None:  # noqa: ANN001
    assert _normalise(spark, [(1, "s", "2015-01-01", "1", "2", "UTC")]).where("id = 9").count() == 0
    rows = [(1, None, None, None, None, None)] * 2 + [(None, None, "2015-01-01", "0100", "0100", "UTC")] * 2
    out = _normalise(spark, rows).collect()
    assert len(out) == 8 and sum(r["moment"] == "2015-01-01T01:00:00.000000Z" for r in out) == 4
    df = spark.createDataFrame([], "id int, src string, day string, a string, b string, z string")
    assert ts.normalise(df, "id", F.col("src"), "day", ("a", "b"), "z", CONVENTIONS).collect() == []


@pytest.mark.parametrize(("per_range", "chunk", "batch"), [(10_000, 50_000, 10_000), (9, 4, 3), (40, 7, 5), (3, 50_000, 2)])
def test_whole_path_costs_the_least(spark, monkeypatch, per_range, chunk, batch) -> None:  # noqa: ANN001
    """Random interpretations: over any ranges, chunks and batches the path costs as little as one found over the whole sequence."""
    monkeypatch.setattr(ts, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rng = random.Random(per_range)
        rows = []
        for i in range(160):
            n = rng.choice([0, 1, 1, 2, 2, 3])
            rows.append((i, rng.choice([None, "p", "p", "q"]), [(rng.choice("xyz"), "ok", rng.choice([None, *range(0, 9 * ts.DAY_US, ts.DAY_US)])) for _ in range(n)]))
        df = spark.createDataFrame(rows, "id int, src string, candidates array<struct<format: string, status: string, moment: bigint>>").repartition(3)
        picks = {r["id"]: r["pick"] for r in ts.choose(df, F.col("src"), F.col("id"), CONVENTIONS, per_range).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for src in (None, "p", "q"):
        own = [(i, [(f, m) for f, _, m in c]) for i, s, c in rows if s == src and c]
        assert all(picks[i] is None for i, s, c in rows if not c)
        states = [c for _, c in own]
        cost = lambda path: sum(ts._costs([a[i]], [b[j]], CONVENTIONS)[0, 0] for a, b, i, j in zip(states, states[1:], path, path[1:], strict=False))  # noqa: B023, E731
        assert cost([picks[i] for i, _ in own]) == pytest.approx(cost(ts.best_path(states, CONVENTIONS)))
