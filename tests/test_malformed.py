from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from panewright.operators import malformed as m

LAYOUTS = {"f": m.Layout(("a", "b", "c"), {"b": m.hhmm_or_null, "c": m.minutes_or_null}), "g": m.Layout(("a", "b"), {"b": m.yes_or_no}), "h": m.Layout(("a",))}


def _parse(spark, rows):  # noqa: ANN001, ANN202
    return m.parse(spark.createDataFrame(rows, "id int, feed string, line string, reason string"), "id", "feed", "line", LAYOUTS)


def _reasons(spark, lines, feed="f") -> list:  # noqa: ANN001
    found = _parse(spark, [(i, feed, x, "z") for i, x in enumerate(lines)]).failures.collect()
    return [sorted(r["reason"] for r in found if r["id"] == i) for i in range(len(lines))]


def test_structure(spark) -> None:  # noqa: ANN001
    lines = ['x,1,1', '"x,y",1,1', '"x""y",1,1', '"x\ny",1,1', 'x"y,1,1', ' "x",1,1', '"x" ,1,1', '"x,1,1', 'x,1', 'x,1,1,', '', None, '"",,', '"a""",1,1', '"a"",1,1', 'x\n,1,1', ',,']
    want = [[], [], [], [], ["quoting"], ["quoting"], ["quoting"], ["quoting"], ["columns"], ["columns"], ["columns"], ["columns"], [], [], ["quoting"], [], []]
    assert _reasons(spark, lines) == want


def test_values(spark) -> None:  # noqa: ANN001
    b = {"": 1, "NA": 1, " NA ": 1, "na": 0, "0": 1, "2400": 1, "2401": 0, "1260": 0, "0059": 1, "12.00": 1, "12.": 0, "12.5": 0, "-1": 0, "+1": 0, " 930 ": 1, "\t930": 0, "٣": 0, "9" * 40: 0, "0" * 40 + "7": 1, "930\n": 0, '"930"': 1, "1e2": 0}
    assert _reasons(spark, [f"x,{v},1" for v in b]) == [[] if ok else ["b"] for ok in b.values()]
    c = {"2880": 1, "2881": 0, "2880.000": 1, "x": 0}
    assert _reasons(spark, [f"x,1,{v}" for v in c]) == [[] if ok else ["c"] for ok in c.values()]
    g = {"YES": 1, "no": 1, " Yes ": 1, "": 0, "NA": 0, "Y": 0}
    assert _reasons(spark, [f"x,{v}" for v in g], "g") == [[] if ok else ["b"] for ok in g.values()]
    assert _reasons(spark, ["x,77,99999"]) == [["b", "c"]]


def test_feeds_repeats_and_empty_tables(spark) -> None:  # noqa: ANN001
    parsed = _parse(spark, [(1, "f", "x,bad,1", None), (1, "f", "x,bad,1", None), (2, None, "x", None), (3, "q", "x", None), (4, "h", "only", None)])
    assert sorted(tuple(r) for r in parsed.failures.collect()) == [(1, "b"), (1, "b"), (2, "feed"), (3, "feed")]
    assert [tuple(r) for r in parsed.loaded["h"].collect()] == [(4, "only")]
    empty = _parse(spark, [(1, "f", "x,1,1", None)])
    assert empty.failures.collect() == [] and empty.loaded["g"].collect() == []
    none = m.parse(spark.createDataFrame([], "id int, feed string, line string"), "id", "feed", "line", LAYOUTS)
    assert none.failures.collect() == [] and all(x.collect() == [] for x in none.loaded.values())


@pytest.mark.parametrize("limit", [None, 0])
def test_large_dictionaries_are_joined_by_shuffle(spark, monkeypatch, limit) -> None:  # noqa: ANN001
    if limit is not None:
        monkeypatch.setattr(m, "BROADCAST_VALUES", limit)
    lines = [f"x,{'bad' if i % 3 == 0 else i % 60},1" for i in range(60)]
    parsed = _parse(spark, [(i, "f", x, None) for i, x in enumerate(lines)])
    assert sorted(r["id"] for r in parsed.failures.collect()) == list(range(0, 60, 3))
    assert sorted(r["id"] for r in parsed.loaded["f"].collect()) == [i for i in range(60) if i % 3]


def test_fields_as_the_csv_module_reads_them(spark) -> None:  # noqa: ANN001
    rng = random.Random(1)
    lines = []
    for _ in range(300):
        fields = ["".join(rng.choice('ab ,"\n') for _ in range(rng.randint(0, 6))) for _ in range(1)]
        lines.append(",".join('"' + f.replace('"', '""') + '"' if set(f) & set(',"\n') else f for f in fields))
    got = {r["id"]: r["a"] for r in _parse(spark, [(i, "h", x, None) for i, x in enumerate(lines)]).loaded["h"].collect()}
    assert got == {i: (next(csv.reader([x], strict=True)) or [""])[0] if "\n" not in x else x[1:-1].replace('""', '"') for i, x in enumerate(lines)}


def test_long_fields_need_no_stack(spark) -> None:  # noqa: ANN001
    line = '"' + 'ab""c,\n' * 200_000 + '",1,1'
    assert _reasons(spark, [line, line[:-5], "x" * 1_000_000 + ",1,1"]) == [[], ["quoting"], []]


def test_values_are_judged_once_each(spark) -> None:  # noqa: ANN001
    df = spark.range(50).select(F.col("id").alias("id"), F.lit("g").alias("feed"), F.lit("x,maybe").alias("line"))
    parsed = m.parse(df, "id", "feed", "line", LAYOUTS)
    assert parsed.failures.count() == 50
    assert [tuple(r) for r in parsed.dictionary.collect()] == [("g", "b", "maybe", "b", 50)]


def test_rules_stand_above_the_aggregate(spark) -> None:  # noqa: ANN001
    """The rule's upper() and the cast appear in the plan only above the aggregation, not below it."""
    df = spark.createDataFrame([("g", "b", "x"), ("f", "b", "1")], "feed string, column string, value string").repartition(2)
    found = m._dictionary(df, [("f", "b", 1, m.hhmm_or_null), ("g", "b", 1, m.yes_or_no)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Aggregate", 1)
    assert "upper(" in above and "RLIKE" in above and "upper(" not in below and "RLIKE" not in below


def test_split_and_pattern_agree(spark) -> None:  # noqa: ANN001
    lines = ["a,b,c", ",,", "a\nb,,", "é,ü,,x", "", "a", "a\r,\t,c"]
    df = spark.createDataFrame([(i, "f", x) for i, x in enumerate(lines)], "id int, feed string, line string")
    pattern = F.regexp_extract_all(F.concat(F.lit(","), F.col("line")), F.lit(f",({m._FIELD})"), F.lit(1))
    assert all(a == b for a, b in df.select(F.split("line", ","), pattern).collect())
