"""An immutable window definition: partition keys, order keys and an optional frame."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from panewright.plans.frame import RANGE, ROWS, RUNNING, WHOLE, Frame

#: A column by name, as it is, or as a function called once a session runs, so that windows can be defined before.
Ref = "str | Column | Callable[[], Column]"


@dataclass(frozen=True, eq=False)
class OrderKey:
    """One sort key. A key given as a bare Column with its own direction (`c.desc()`) is taken apart; where the session doesn't show its parts, it is
    opaque and can't be reversed."""

    column: Ref
    ascending: bool = True
    nulls_first: bool = True
    opaque: bool = False

    def to_column(self) -> Column:
        if self.opaque:
            return self.column
        c = resolve(self.column)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()

    def reversed(self) -> OrderKey:
        if self.opaque:
            raise ValueError("an opaque sort key can't be reversed; use asc() or desc()")
        return replace(self, ascending=not self.ascending, nulls_first=not self.nulls_first)


def resolve(x: Ref) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else x()


def asc(x: Ref, nulls_first: bool = True) -> OrderKey:
    return OrderKey(x, True, nulls_first)


def desc(x: Ref, nulls_first: bool = False) -> OrderKey:
    return OrderKey(x, False, nulls_first)


def _order_key(x: Ref | OrderKey) -> OrderKey:
    if isinstance(x, OrderKey):
        return x
    if isinstance(x, Column) and (said := re.search(r" (ASC|DESC) NULLS (FIRST|LAST)'>\Z", str(x))):
        child = _sorted_child(x)
        return OrderKey(x, opaque=True) if child is None else OrderKey(child, said[1] == "ASC", said[2] == "FIRST")
    return asc(x)


def _sorted_child(x: Column) -> Column | None:
    """The column that a Column with a direction sorts by, if the session's JVM gives it."""
    try:
        child = x._jc.node().child()
        return type(x)(x._jc.getClass().getConstructors()[0].newInstance(_array(child)))
    except Exception:  # noqa: BLE001  (a session without a JVM, or another layout of the node)
        return None


def _array(item: object) -> object:
    from pyspark import SparkContext

    gateway = SparkContext._active_spark_context._gateway
    out = gateway.new_array(gateway.jvm.java.lang.Object, 1)
    out[0] = item
    return out


class FrameMethods:
    """The frame builder methods. A class that mixes this in says what editing its windows means."""

    def _edit(self, change: Callable[[WindowDef], WindowDef]):  # noqa: ANN202
        raise NotImplementedError

    def _reframe(self, change: Callable[[Frame | None], Frame | None]):  # noqa: ANN202
        return self._edit(lambda w: replace(w, frame=change(w.frame)))

    def partition_by(self, *keys: Ref):  # noqa: ANN201
        """Replaces the partition keys."""
        return self._edit(lambda w: replace(w, partition=keys))

    def order_by(self, *keys: Ref | OrderKey):  # noqa: ANN201
        """Replaces the order keys; plain columns sort ascending, NULLs first."""
        return self._edit(lambda w: replace(w, order=tuple(map(_order_key, keys))))

    def running(self):  # noqa: ANN201
        """ROWS UNBOUNDED PRECEDING .. CURRENT ROW."""
        return self._reframe(lambda f: RUNNING)

    def shifted(self, n: int):  # noqa: ANN201
        """ROWS n .. n: the single row n ahead (behind, if negative)."""
        return self._reframe(lambda f: Frame(ROWS, n, n))

    def rows_preceding(self, n: int):  # noqa: ANN201
        return self._reframe(lambda f: (f or WHOLE).starting(ROWS, n))

    def rows_following(self, n: int):  # noqa: ANN201
        """The upper bound; a negative n ends the frame before the current row."""
        return self._reframe(lambda f: (f or WHOLE).ending(ROWS, n))

    def values_preceding(self, n: int):  # noqa: ANN201
        return self._reframe(lambda f: (f or WHOLE).starting(RANGE, n))

    def values_following(self, n: int):  # noqa: ANN201
        return self._reframe(lambda f: (f or WHOLE).ending(RANGE, n))

    def unbounded_preceding(self):  # noqa: ANN201
        """Opens the start; a frame open at both ends is no frame, which means the whole partition."""
        return self._reframe(lambda f: None if f is None or f.high is None else Frame(f.kind, None, f.high))

    def unbounded_following(self):  # noqa: ANN201
        return self._reframe(lambda f: None if f is None or f.low is None else Frame(f.kind, f.low, None))


@dataclass(frozen=True, eq=False)
class WindowDef(FrameMethods):
    """A window; `frame` None means the whole partition, with or without an order."""

    partition: tuple[Ref, ...] = ()
    order: tuple[OrderKey, ...] = ()
    frame: Frame | None = None

    def _edit(self, change: Callable[[WindowDef], WindowDef]) -> WindowDef:
        return change(self)

    def merged(self, other: WindowDef) -> WindowDef:
        """This window with what `other` states: non-empty keys and a frame replace, the rest stays."""
        return WindowDef(other.partition or self.partition, other.order or self.order, other.frame or self.frame)

    def reversed(self) -> WindowDef:
        return WindowDef(self.partition, tuple(k.reversed() for k in self.order), self.frame and self.frame.reversed())

    @property
    def reversible(self) -> bool:
        return bool(self.order) and not any(k.opaque for k in self.order)

    def base(self) -> WindowSpec:
        """Keys only, for functions whose frame is fixed."""
        spec = Window.partitionBy(*map(resolve, self.partition))
        return spec.orderBy(*(k.to_column() for k in self.order)) if self.order else spec

    def framed(self, frame: Frame | None = None) -> WindowSpec:
        """Keys and an explicit frame, since Spark's default with an order is the running RANGE frame."""
        f = frame or self.frame or WHOLE
        if f.inverted:
            raise ValueError(f"the frame starts at {f.low} and ends at {f.high}, before its start")
        low = Window.unboundedPreceding if f.low is None else f.low
        high = Window.unboundedFollowing if f.high is None else f.high
        if f.kind == RANGE and not f.whole:
            if not self.order:
                raise ValueError("a RANGE frame needs an order")
            bounded = any(b not in (None, 0) for b in (f.low, f.high))
            if bounded and len(self.order) != 1:
                raise ValueError("a RANGE frame with an offset needs exactly one order key")
            return self.base().rangeBetween(low, high)
        return self.base().rowsBetween(low, high)


def window(base: WindowDef | None = None) -> WindowDef:
    """A reusable window without keys or frame, or the one given."""
    return base or WindowDef()
