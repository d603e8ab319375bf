"""Rewrites of windowed aggregates, done in Python before Spark plans the query.

Spark evaluates a frame that ends at UNBOUNDED FOLLOWING in time quadratic in the partition's rows, and a sliding frame in rows
times width. Each rewrite below gives the same result in linear time.

Differences of prefixes are taken so that no part of them can overflow where the frame's own sum fits: a bigint is summed as its upper and lower 32 bits
apart (exact for up to 2^31 rows a partition), a decimal in a sum type of ten more digits (10^10 rows), and one whose sum has no such room isn't rewritten.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from panewright.plans.frame import RANGE, ROWS, WHOLE, Frame
from panewright.plans.window import WindowDef, resolve

Make = Callable[[str, tuple[Column, ...]], Column]

#: Aggregates that give the same value whatever the order of their input, and those that swap when it is reversed.
_ORDER_FREE = {"sum", "count", "min", "max", "avg", "stddev"}
_SWAPPED = {"first": "last", "last": "first"}
_LOW = 0xFFFFFFFF


@dataclass(frozen=True)
class Rewrites:
    """Which rewrites may be used.

    prefix: SUM and COUNT of exact types over `n .. UNBOUNDED FOLLOWING` as total minus prefix, unless the order may be reversed.
    reverse: other aggregates over `n .. UNBOUNDED FOLLOWING` with the order reversed; for ROWS only under `unique_order`.
    slide: SUM and COUNT of exact types over a sliding frame, of at least `slide_from` rows or of values, as a difference of prefixes.
    shift: MIN, MAX, and SUM and AVG of a stated type, over a single other row as lead or lag.
    distinct: COUNT(DISTINCT) over frames open at one or both ends as a count of first occurrences; for ROWS only under `unique_order`.
    unique_order: the caller's word that no two rows of a partition tie in the order.
    empty_as_null: an inverted frame is empty (NULL, or 0 for COUNT) in place of an error.
    """

    prefix: bool = True
    reverse: bool = True
    slide: bool = True
    slide_from: int = 32
    shift: bool = True
    unique_order: bool = False
    empty_as_null: bool = False
    distinct: bool = True

    @staticmethod
    def none() -> Rewrites:
        return Rewrites(prefix=False, reverse=False, slide=False, shift=False, distinct=False)


def aggregate(name: str, args: tuple[Column, ...], result_type: str | None, make: Make, w: WindowDef, use: Rewrites) -> Column:
    """The column for aggregate `name` (built by `make(name, args)`) over `w`."""
    frame = w.frame or WHOLE
    if frame.inverted:
        if not use.empty_as_null:
            raise ValueError(f"the frame starts at {frame.low} and ends at {frame.high}, before its start")
        return F.lit(0).cast("bigint") if name in ("count", "count_distinct") else F.lit(None).cast(result_type or "void")
    if name == "count_distinct":
        return _distinct(args[0], w, frame, use)
    bounded = None not in (frame.low, frame.high)
    if bool(w.order) and (name == "count" or name == "sum" and _roomy(result_type)):
        turning = use.reverse and use.unique_order and w.reversible
        if frame.kind == ROWS and use.prefix and not turning and frame.low is not None and frame.high is None:
            return _difference(name, args, result_type, make, [w.framed(WHOLE)], [w.framed(Frame(ROWS, None, frame.low - 1))])
        if frame.kind == ROWS and use.slide and bounded and frame.high - frame.low + 1 >= max(2, use.slide_from):
            return _difference(name, args, result_type, make, [w.framed(Frame(ROWS, None, frame.high))], [w.framed(Frame(ROWS, None, frame.low - 1))])
        if frame.kind == RANGE and use.slide and bounded and frame.low < frame.high and w.reversible and len(w.order) == 1:
            # What is up to the end, and what is from the start on, count the frame twice and all else once.
            ends = [w.framed(Frame(RANGE, None, frame.high)), w.reversed().framed(Frame(RANGE, None, -frame.low))]
            return _difference(name, args, result_type, make, ends, [w.framed(WHOLE)])
    if use.shift and frame.kind == ROWS and w.order and frame.low is not None and frame.low == frame.high:
        if name in ("min", "max") or name in ("sum", "avg") and result_type:
            moved = args[0] if frame.low == 0 else F.lead(args[0], frame.low).over(w.base()) if frame.low > 0 else F.lag(args[0], -frame.low).over(w.base())
            return moved.cast(result_type) if result_type else moved
    if use.reverse and frame.low is not None and frame.high is None and w.reversible and (name in _ORDER_FREE or name in _SWAPPED):
        if frame.kind != ROWS and name not in _SWAPPED or use.unique_order:
            turned = w.reversed()
            return make(_SWAPPED.get(name, name), args).over(turned.framed())
    return make(name, args).over(w.framed())


def _roomy(result_type: str | None) -> bool:
    """Whether prefixes of a sum of this type can't overflow."""
    said = (result_type or "").lower().replace(" ", "")
    decimal = re.fullmatch(r"(?:decimal|dec|numeric)\((\d+)(?:,\d+)?\)", said)
    return said in ("bigint", "long") or bool(decimal) and int(decimal[1]) < 38


def _difference(name: str, args: tuple[Column, ...], result_type: str | None, make: Make, plus: list[WindowSpec], minus: list[WindowSpec]) -> Column:
    """The aggregates over `plus` less those over `minus`; NULL where no value remains."""

    def total(what: str, x: tuple[Column, ...], zero: Column) -> Column:
        out = None
        for spec in plus:
            v = F.coalesce(make(what, x).over(spec), zero)
            out = v if out is None else out + v
        for spec in minus:
            out = out - F.coalesce(make(what, x).over(spec), zero)
        return out

    counted = total("count", args, F.lit(0).cast("bigint"))
    if name == "count":
        return counted
    if result_type.lower().strip() in ("bigint", "long"):
        zero = F.lit(0).cast("bigint")
        upper = total("sum", (F.shiftright(args[0].cast("bigint"), 32),), zero)
        lower = total("sum", (args[0].cast("bigint").bitwiseAND(F.lit(_LOW)),), zero)
        value = (upper + F.shiftright(lower, 32)) * F.lit(_LOW + 1) + lower.bitwiseAND(F.lit(_LOW))
    else:
        value = total("sum", args, F.lit(0).cast(result_type))
    return F.when(counted > 0, value).cast(result_type)


def _distinct(x: Column, w: WindowDef, frame: Frame, use: Rewrites) -> Column:
    """COUNT(DISTINCT x), 0 over an empty frame. Where the frame is open at an end, each value counts at its first occurrence from there."""
    anchored = w if frame.low is None else w.reversed() if frame.high is None and w.reversible else None
    if use.distinct and anchored is not None and (frame.whole or frame.kind == RANGE or use.unique_order):
        of_value = Window.partitionBy(*map(resolve, w.partition), x).orderBy(*([k.to_column() for k in anchored.order] or [x]))
        begins = F.when(x.isNotNull() & (F.row_number().over(of_value) == 1), 1)
        return F.count(begins).over(anchored.framed())
    return F.coalesce(F.size(F.collect_set(x).over(w.framed())), F.lit(0)).cast("bigint")
