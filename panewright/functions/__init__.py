"""Functions that make windowed expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from panewright.plans.expr import Aggregate, Composite, Leaf, Node, Ranking, Shift, node
from panewright.plans.window import Ref, WindowDef


_MAKE: dict[str, Callable[..., Column]] = {
    "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg, "stddev": F.stddev_samp, "first": F.first, "last": F.last,
}


def _make(name: str, args: tuple[Column, ...]) -> Column:
    return _MAKE[name](*args)


def col(name: str) -> Node:
    return Leaf(name)


def lit(value: object) -> Node:
    return Leaf(lambda: F.lit(value))


def sum_(x: Ref | Node, exact_type: str | None = None) -> Aggregate:
    """SUM. `exact_type` states the result's exact type (`bigint`, `decimal(28,2)`), which permits prefix arithmetic."""
    return Aggregate(WindowDef(), "sum", (x,), _make, exact_type)


def count(x: Ref | Node | None = None) -> Aggregate:
    """COUNT of non-null values, or of rows."""
    return Aggregate(WindowDef(), "count", ((lambda: F.lit(1)) if x is None else x,), _make)


def avg(x: Ref | Node, result_type: str | None = None) -> Aggregate:
    return Aggregate(WindowDef(), "avg", (x,), _make, result_type)


def min_(x: Ref | Node) -> Aggregate:
    return Aggregate(WindowDef(), "min", (x,), _make)


def max_(x: Ref | Node) -> Aggregate:
    return Aggregate(WindowDef(), "max", (x,), _make)


def first(x: Ref | Node) -> Aggregate:
    return Aggregate(WindowDef(), "first", (x,), _make)


def last(x: Ref | Node) -> Aggregate:
    return Aggregate(WindowDef(), "last", (x,), _make)


def stddev(x: Ref | Node) -> Aggregate:
    return Aggregate(WindowDef(), "stddev", (x,), _make)


def count_distinct(x: Ref | Node) -> Aggregate:
    """COUNT(DISTINCT x) over a frame, which Spark's windows reject: a count of first occurrences where the frame is open at an end, else the size of
    the frame's set."""
    return Aggregate(WindowDef(), "count_distinct", (x,), _make)


def percentile(x: Ref | Node, q: float) -> Aggregate:
    return Aggregate(WindowDef(), "percentile", (x,), lambda _, args: F.percentile(args[0], q))


def agg(function: Callable[..., Column], *args: Ref | Node) -> Aggregate:
    """Any aggregate that Spark admits over a window, grouped-aggregate Pandas UDFs included; never rewritten."""
    return Aggregate(WindowDef(), "other", args, lambda _, a: function(*a))


def row_number() -> Ranking:
    return Ranking(WindowDef(), F.row_number)


def rank() -> Ranking:
    return Ranking(WindowDef(), F.rank)


def dense_rank() -> Ranking:
    return Ranking(WindowDef(), F.dense_rank)


def ntile(n: int) -> Ranking:
    return Ranking(WindowDef(), lambda: F.ntile(n))


def percent_rank() -> Ranking:
    return Ranking(WindowDef(), F.percent_rank, None)


def cume_dist() -> Ranking:
    return Ranking(WindowDef(), F.cume_dist, None)


def shift(x: Ref | Node, offset: int) -> Shift:
    return Shift(WindowDef(), x, offset)


def lead(x: Ref | Node, n: int = 1) -> Shift:
    return shift(x, n)


def lag(x: Ref | Node, n: int = 1) -> Shift:
    return shift(x, -n)


def coalesce(*parts: object) -> Node:
    return Composite(F.coalesce, tuple(map(node, parts)))


def when(condition: object, value: object, otherwise: object = None) -> Node:
    return Composite(lambda c, a, b: F.when(c, a).otherwise(b), (node(condition), node(value), node(otherwise)))
