"""Windows that can be computed as rows arrive: row numbers, running totals and extremes, and the value before, over streams.

Spark rejects ROWS frames on streams. A running frame needs no row again, only what its partition has added up to, so the state of a key is a few numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADDED = ("n", "total", "least", "most", "before")


def _kind(t: T.DataType) -> tuple[str, Callable[[object], object]]:
    """The type of totals of a value, and what makes a value one of it."""
    if isinstance(t, T.IntegralType | T.BooleanType):
        return "bigint", int
    if isinstance(t, T.DecimalType):
        return f"decimal(38,{t.scale})", lambda x: x if isinstance(x, Decimal) else Decimal(str(x))
    return "double", float


def running(stream: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The rows of a stream with `n` (row number), `total`, `least` and `most` of `value` so far, and `before`, the value of the row before, per key.

    Totals of whole numbers are bigint and those of decimals decimal(38), both exact, others double; a bigint total that doesn't fit is an error. Within a micro-batch rows go by `order`, nulls first; a later
    batch goes on where the last one ended, whatever its order values. A null value adds to nothing but `n`; NaN is a null. Null keys are a key. Rows come
    out once, in append mode; a key's state survives restarts with the query's checkpoint.
    """
    if clash := set(ADDED) & {c.lower() for c in stream.columns}:
        raise ValueError(f"the stream has the columns {sorted(clash)} already")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    names = [f.name for f in stream.schema.fields]
    kind, make = _kind(stream.schema[value].dataType)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, *carried = state.get if state.exists else (0, None, None, None, None)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable", na_position="first", ignore_index=True)
        values = [None if x is None or x != x else make(x) for x in rows[value].astype(object)]
        some = lambda f: lambda a, b: b if a is None else a if b is None else f(a, b)
        total, least, most = (list(accumulate([c, *values], some(f)))[1:] for f, c in zip((lambda a, b: a + b, min, max), carried[:3], strict=True))
        before = [carried[3], *values[:-1]]
        columns = {c: pd.Series(x, dtype=object) for c, x in (("total", total), ("least", least), ("most", most), ("before", before))}
        if kind == "bigint":
            if any(x is not None and not -(2**63) <= x < 2**63 for x in total):
                raise OverflowError("a running total doesn't fit 64 bits")
            columns = {c: pd.array([pd.NA if x is None else x for x in s], dtype="Int64") for c, s in columns.items()}
        elif kind == "double":
            columns = {c: s.astype(float) for c, s in columns.items()}
        state.update((n + len(rows), total[-1], least[-1], most[-1], values[-1]))
        yield rows[names].assign(n=np.arange(n + 1, n + 1 + len(rows)), **columns)

    added = ", ".join(f"{c} {'bigint' if c == 'n' else kind}" for c in ADDED)
    return stream.groupBy(*keys).applyInPandasWithState(step, f"{fields}, {added}", added.replace("before ", "last "), "append", GroupStateTimeout.NoTimeout)
