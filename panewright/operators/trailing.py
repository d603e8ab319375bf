"""Totals, averages and extremes over trailing periods, for each entity and calendar day.

Rows are first reduced to one state per entity and day (map-side combined, so a hot entity costs at most its days). The states are
spread by entity and sorted by day; each task lays blocks of entities out as arrays, day by day, and runs one two-stack queue per
period over the days. The queue's elements are arrays over the block's entities, so a step costs a few vector operations, and any
associative operation with a neutral element will do, inverse or not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entities times days in a block at most (one entity at least): its grids and results then take some 30 MB, whatever the span.
BLOCK_CELLS = 200_000


@dataclass(frozen=True)
class Monoid:
    """An associative operation on arrays and its neutral element."""

    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]
    neutral: float | int


MONOIDS = {
    "sum": Monoid(np.add, 0),
    "count": Monoid(np.add, 0),
    "min": Monoid(np.minimum, np.inf),
    "max": Monoid(np.maximum, -np.inf),
}
#: Neutral elements of MIN and MAX among 64-bit integers.
_INT64 = np.iinfo(np.int64)


class TwoStackQueue:
    """A queue that knows the combination of all it holds: O(1) amortised per step, without an inverse.

    Elements enter at the back, whose combination is kept running, and leave from the front, a stack of combinations of each element
    with those behind it; an empty front takes over the back.
    """

    def __init__(self, monoid: Monoid) -> None:
        self.monoid = monoid
        self.front: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        self.back_total: np.ndarray | None = None

    def push(self, x: np.ndarray) -> None:
        self.back.append(x)
        self.back_total = x if self.back_total is None else self.monoid.combine(self.back_total, x)

    def pop(self) -> None:
        if not self.front:
            total = None
            while self.back:
                x = self.back.pop()
                total = x if total is None else self.monoid.combine(x, total)
                self.front.append(total)
            self.back_total = None
        self.front.pop()

    def total(self) -> np.ndarray:
        parts = [x for x in (self.front[-1] if self.front else None, self.back_total) if x is not None]
        return parts[0] if len(parts) == 1 else self.monoid.combine(*parts)

    def __len__(self) -> int:
        return len(self.front) + len(self.back)


def trailing(days: np.ndarray, monoid: Monoid, width: int) -> np.ndarray:
    """For an array by day and entity, the combination of the `width` days that end on each day."""
    out, queue = np.empty_like(days), TwoStackQueue(monoid)
    for i in range(len(days)):
        queue.push(days[i])
        if len(queue) > width:
            queue.pop()
        out[i] = queue.total()
    return out


def rolling(df: DataFrame, entity: Column, day: Column, value: Column, start: date, end: date, periods: tuple[int, ...] = (7, 30), name: str = "entity") -> DataFrame:
    """One row per entity with a dated row and day of start .. end: over each trailing period of p days, `total_pd`, `n_pd`, `mean_pd`,
    `least_pd` and `most_pd` of `value`.

    Columns: `name`, `day`, and those. A period is p calendar days ending that day; days before `start` count where there are rows.
    Rows without entity or day are left out, and rows after `end` only make their entity appear. A null or NaN value adds to nothing; infinite ones count as they
    are. All rows count, repeated ones too. Without values in a period its total and n are 0, the others null. An empty table gives no rows.
    Integral values give exact bigint totals and extremes, and an error where a total doesn't fit; others give double.
    """
    if end < start or not periods or min(periods) < 1:
        raise ValueError("the days or periods are empty")
    kind = df.select(value.alias("v")).schema["v"].dataType
    whole = isinstance(kind, T.IntegralType | T.BooleanType)
    number = "bigint" if whole else "double"
    v = value.cast(number)
    known = v if whole else F.when(~F.isnan(v), v)
    held = df.select(entity.alias("e"), F.unix_date(day.cast("date")).alias("d"), known.alias("v")).where("e is not null and d is not null")
    states = held.groupBy("e", "d").agg(F.coalesce(F.sum("v"), F.lit(0).cast(number)).alias("total"), F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    # Without nulls whole numbers stay exact on their way; n says where there is none.
    states = states.withColumns({c: F.coalesce(c, F.lit(0).cast(number)) for c in ("least", "most")})
    longest, first, last = max(periods), (start - date(1970, 1, 1)).days, (end - date(1970, 1, 1)).days
    columns = [f"{c}_{p}d {k}" for p in periods for c, k in (("total", number), ("n", "bigint"), ("mean", "double"), ("least", number), ("most", number))]
    names = [name, "day", *(c.split()[0] for c in columns)]
    dtype = np.int64 if whole else np.float64
    least, most = (Monoid(np.minimum, _INT64.max), Monoid(np.maximum, _INT64.min)) if whole else (MONOIDS["min"], MONOIDS["max"])
    span, n_days = last - first + longest, last - first + 1
    block_size = max(1, BLOCK_CELLS // span)

    def block(entities: pa.Array, index: np.ndarray, rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        at = rows["d"] - (first - longest + 1)
        inside = (at >= 0) & (at < span)
        at, who, some = at[inside], index[inside], rows["n"][inside] > 0
        grids: dict[str, np.ndarray] = {}
        for c, monoid, of in (("total", MONOIDS["sum"], dtype), ("n", MONOIDS["count"], np.int64), ("least", least, dtype), ("most", most, dtype)):
            grids[c] = np.full((span, len(entities)), monoid.neutral, dtype=of)
            grids[c][at, who] = np.where(some, rows[c][inside], monoid.neutral)
        if whole and len(at) and np.abs(grids["total"].astype(float)).max() * longest >= 2.0**62:
            sums = trailing(grids["total"].astype(object), MONOIDS["sum"], longest)
            if sums.max() > _INT64.max or sums.min() < _INT64.min:
                raise OverflowError("a trailing total doesn't fit 64 bits")
        out = [entities.take(pa.array(np.repeat(np.arange(len(entities)), n_days))), pa.array(np.tile(np.arange(first, last + 1, dtype=np.int32), len(entities)), pa.int32()).cast(pa.date32())]
        for p in periods:
            total, n, lo, hi = (trailing(grids[c], m, p)[longest - 1 :].T.ravel() for c, m in (("total", MONOIDS["sum"]), ("n", MONOIDS["count"]), ("least", least), ("most", most)))
            none = n == 0
            out += [pa.array(total), pa.array(n), pa.array(total / np.maximum(n, 1), mask=none), pa.array(lo, mask=none), pa.array(hi, mask=none)]
        return pa.RecordBatch.from_arrays(out, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition comes sorted by entity; its last entity may go on in the next batch."""
        kept: list[pa.Table] = []

        def cut(t: pa.Table, whole_input: bool) -> Iterator[pa.RecordBatch]:
            coded = t.column("e").combine_chunks().dictionary_encode()
            codes, entities = np.asarray(coded.indices), coded.dictionary
            rows = {c: t.column(c).to_numpy() for c in ("d", "total", "n", "least", "most")}
            ends = len(entities) if whole_input else len(entities) - 1
            for low in range(0, ends, block_size):
                high = min(low + block_size, ends)
                a, b = np.searchsorted(codes, [low, high])
                yield block(entities.slice(low, high - low), codes[a:b] - low, {c: x[a:b] for c, x in rows.items()})
            kept[:] = [t.slice(int(np.searchsorted(codes, ends)))] if ends < len(entities) else []

        for b in batches:
            if b.num_rows:
                yield from cut(pa.concat_tables([*kept, pa.Table.from_batches([b])]), False)
        if kept:
            yield from cut(kept[0], True)

    entity_kind = held.schema["e"].dataType.simpleString()
    spread = states.repartition("e").sortWithinPartitions("e", "d")
    return spread.mapInArrow(run, f"`{name}` {entity_kind}, day date, {', '.join(columns)}")
