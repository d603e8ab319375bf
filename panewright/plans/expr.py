"""Deferred windowed expressions: small trees whose windows can still be changed, until `col()` compiles them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from panewright.plans.rewrite import Rewrites, aggregate
from panewright.plans.window import FrameMethods, Ref, WindowDef, resolve


class Node(FrameMethods):
    """A node of the tree. Building methods return changed copies and reach every windowed part below, those inside arguments of others too."""

    def children(self) -> tuple[Node, ...]:
        return ()

    def with_children(self, children: tuple[Node, ...]) -> Node:
        return self

    def _edit(self, change: Callable[[WindowDef], WindowDef]) -> Node:
        return self.with_children(tuple(c._edit(change) for c in self.children()))

    def over(self, w: WindowDef | Node | None = None) -> Node:
        """Puts every aggregate, ranking and shift inside over `w`, merging with a window that is there already."""
        given = WindowDef() if w is None else w if isinstance(w, WindowDef) else w.first_window()
        return self._edit(lambda old: old.merged(given))

    def first_window(self) -> WindowDef:
        for c in self.children():
            try:
                return c.first_window()
            except LookupError:
                continue
        raise LookupError("the expression has no window")

    def compile(self, use: Rewrites) -> Column:
        raise NotImplementedError

    def col(self, use: Rewrites | None = None) -> Column:
        return self.compile(use or Rewrites())

    def alias(self, name: str) -> Node:
        return Composite(lambda c: c.alias(name), (self,))

    def cast(self, kind: str) -> Node:
        return Composite(lambda c: c.cast(kind), (self,))

    def is_null(self) -> Node:
        return Composite(lambda c: c.isNull(), (self,))

    def is_not_null(self) -> Node:
        return Composite(lambda c: c.isNotNull(), (self,))

    def isin(self, *values: object) -> Node:
        """Whether the value is one of `values`, which may be windowed too."""
        return Composite(lambda c, *vs: c.isin(*vs), (self, *map(node, values)))

    def between(self, low: object, high: object) -> Node:
        return Composite(lambda c, a, b: c.between(a, b), (self, node(low), node(high)))

    def __invert__(self) -> Node:
        return Composite(lambda c: ~c, (self,))

    def __neg__(self) -> Node:
        return Composite(lambda c: -c, (self,))

    def __bool__(self) -> bool:
        raise TypeError("use & and | in place of 'and' and 'or'")

    __hash__ = object.__hash__


def _binary(method: str) -> Callable[[Node, object], Node]:
    return lambda self, other: Composite(lambda a, b: getattr(a, method)(b), (self, node(other)))


for _name in ("add", "sub", "mul", "truediv", "mod", "pow", "eq", "ne", "lt", "le", "gt", "ge", "and", "or", "radd", "rsub", "rmul", "rtruediv", "rmod", "rand", "ror"):
    setattr(Node, f"__{_name}__", _binary(f"__{_name}__"))


Arg = "Ref | Node"


def edited(x: Arg, change: Callable[[WindowDef], WindowDef]) -> Arg:
    return x._edit(change) if isinstance(x, Node) else x


def compiled(x: Arg, use: Rewrites) -> Column:
    return x.compile(use) if isinstance(x, Node) else resolve(x)


def node(x: object) -> Node:
    return x if isinstance(x, Node) else Leaf(x if isinstance(x, Column) or callable(x) else lambda: F.lit(x))


@dataclass(frozen=True, eq=False)
class Leaf(Node):
    """A column, taken as it is."""

    column: Ref

    def compile(self, use: Rewrites) -> Column:
        return resolve(self.column)


@dataclass(frozen=True, eq=False)
class Composite(Node):
    """A function of other nodes."""

    build: Callable[..., Column]
    parts: tuple[Node, ...]

    def children(self) -> tuple[Node, ...]:
        return self.parts

    def with_children(self, children: tuple[Node, ...]) -> Node:
        return replace(self, parts=children)

    def compile(self, use: Rewrites) -> Column:
        return self.build(*(p.compile(use) for p in self.parts))


@dataclass(frozen=True, eq=False)
class Windowed(Node):
    """A node that owns a window. Its arguments may hold windowed parts of their own, which edits reach too."""

    window: WindowDef

    def first_window(self) -> WindowDef:
        return self.window


@dataclass(frozen=True, eq=False)
class Aggregate(Windowed):
    """An aggregate over a frame. `result_type`, if stated, is its exact SQL type and allows more rewrites."""

    name: str
    args: tuple[Arg, ...]
    make: Callable[[str, tuple[Column, ...]], Column]
    result_type: str | None = None

    def children(self) -> tuple[Node, ...]:
        return tuple(a for a in self.args if isinstance(a, Node))

    def _edit(self, change: Callable[[WindowDef], WindowDef]) -> Node:
        return replace(self, window=change(self.window), args=tuple(edited(a, change) for a in self.args))

    def compile(self, use: Rewrites) -> Column:
        return aggregate(self.name, tuple(compiled(a, use) for a in self.args), self.result_type, self.make, self.window, use)


@dataclass(frozen=True, eq=False)
class Ranking(Windowed):
    """A ranking function; its frame is fixed, so a frame on the window doesn't matter."""

    build: Callable[[], Column]
    kind: str | None = "bigint"

    def _edit(self, change: Callable[[WindowDef], WindowDef]) -> Node:
        return replace(self, window=change(self.window))

    def compile(self, use: Rewrites) -> Column:
        c = self.build().over(self.window.base())
        return c.cast(self.kind) if self.kind else c


@dataclass(frozen=True, eq=False)
class Shift(Windowed):
    """The value of an expression `offset` rows ahead (behind, if negative), NULL outside the partition."""

    column: Arg
    offset: int

    def children(self) -> tuple[Node, ...]:
        return (self.column,) if isinstance(self.column, Node) else ()

    def _edit(self, change: Callable[[WindowDef], WindowDef]) -> Node:
        return replace(self, window=change(self.window), column=edited(self.column, change))

    def compile(self, use: Rewrites) -> Column:
        c = compiled(self.column, use)
        if self.offset == 0:
            return c
        return (F.lead if self.offset > 0 else F.lag)(c, abs(self.offset)).over(self.window.base())
