"""The builder's algebra, without a session."""

from __future__ import annotations

import pytest

from panewright import Frame, WindowDef, window
from panewright.plans.expr import Composite
from panewright.functions import coalesce, lit, row_number, sum_


def test_frames_follow_the_builder() -> None:
    w = window()
    assert w.frame is None
    assert w.rows_preceding(3).frame == Frame("rows", -3, None)
    assert w.rows_preceding(3).rows_following(-1).frame == Frame("rows", -3, -1)
    assert w.rows_preceding(0).frame == Frame("rows", 0, None)
    assert w.unbounded_preceding().rows_following(0).frame == Frame("rows", None, 0)
    assert w.rows_following(2).unbounded_following().frame is None
    assert w.rows_preceding(2).unbounded_preceding().frame is None
    assert w.rows_preceding(2).rows_following(1).unbounded_following().frame == Frame("rows", -2, None)
    assert w.shifted(-2).frame == Frame("rows", -2, -2)
    assert w.running().frame == Frame("rows", None, 0)


def test_last_bound_decides_the_kind_of_both() -> None:
    assert window().rows_preceding(3).values_following(5).frame == Frame("range", -3, 5)
    assert window().values_preceding(3).rows_following(5).frame == Frame("rows", -3, 5)


def test_reversal_swaps_bounds() -> None:
    assert Frame("rows", 2, None).reversed() == Frame("rows", None, -2)
    assert Frame("range", -1, 4).reversed() == Frame("range", -4, 1)
    assert window().order_by("a").rows_preceding(1).reversed().order[0].ascending is False


def test_bounds_are_checked() -> None:
    with pytest.raises(ValueError, match="32 bits"):
        Frame("rows", -(2**40), 0)
    with pytest.raises(TypeError):
        Frame("rows", 1.5, 2)
    with pytest.raises(ValueError, match="ROWS or RANGE"):
        Frame("groups", 0, 0)


def test_over_reaches_every_windowed_part_and_merges() -> None:
    w = window().partition_by("a").order_by("b")
    e = coalesce(sum_("x").over(w).rows_preceding(3).rows_following(-1), lit(0)) + row_number()
    moved = e.over(window().partition_by("c"))
    parts = moved.children()[0].children()[0], moved.children()[1]
    assert [p.window.partition for p in parts] == [("c",), ("c",)]
    assert parts[0].window.frame == Frame("rows", -3, -1)
    assert len(parts[0].window.order) == 1
    assert isinstance(e, Composite)


def test_builders_dont_change_what_they_build_on() -> None:
    w = WindowDef()
    w.partition_by("a").order_by("b").running()
    assert w.partition == () and w.order == () and w.frame is None
    with pytest.raises(TypeError):
        bool(sum_("x") > lit(1))
