"""Window frames and the algebra of the builder methods that change them."""

from __future__ import annotations

from dataclasses import dataclass

ROWS, RANGE = "rows", "range"
_INT32 = 2**31 - 1


@dataclass(frozen=True)
class Frame:
    """ROWS or RANGE between two signed offsets; None is unbounded, 0 the current row, negative is before it."""

    kind: str = ROWS
    low: int | None = None
    high: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in (ROWS, RANGE):
            raise ValueError(f"a frame is ROWS or RANGE, not {self.kind!r}")
        for bound in (self.low, self.high):
            if bound is not None and (isinstance(bound, bool) or not isinstance(bound, int)):
                raise TypeError(f"a frame bound is an int or None, not {bound!r}")
            if bound is not None and abs(bound) > _INT32:
                raise ValueError(f"frame bound {bound} doesn't fit 32 bits")

    @property
    def whole(self) -> bool:
        return self.low is None and self.high is None

    @property
    def inverted(self) -> bool:
        """Starts after its own end, so that it never holds a row."""
        return self.low is not None and self.high is not None and self.low > self.high

    def starting(self, kind: str, before: int) -> Frame:
        """The frame with its start `before` rows or values ahead of the current row; the kind holds for both bounds."""
        return Frame(kind, -before, self.high)

    def ending(self, kind: str, after: int) -> Frame:
        return Frame(kind, self.low, after)

    def reversed(self) -> Frame:
        """The same rows, seen in the opposite order."""
        turn = lambda x: None if x is None else -x
        return Frame(self.kind, turn(self.high), turn(self.low))


WHOLE = Frame()
RUNNING = Frame(ROWS, None, 0)
