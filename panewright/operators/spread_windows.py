"""Windows over partitions that hold most rows, or over tables without partition keys.

Spark gives a window partition to one task. Here the hot partitions, few by definition, are sorted by ranges over all tasks, which gives every row its position in
its partition. Blocks of positions are then windowed separately: rows near a block's ends are copied to the neighbour, as far as the frames and shifts
reach, and frames that are open at an end are completed by the totals of the blocks beyond. All other partitions are windowed as they are.

The work on hot rows: one count by key, one sort by ranges that is kept in the shared folder, two aggregations of that to a row per block, and one shuffle into
blocks. Only hot keys (at most 1 / share) and rows per block (at most MOST_BLOCKS) are collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panewright.plans.expr import Aggregate, Node, Ranking, Shift, compiled
from panewright.plans.frame import ROWS, RUNNING, WHOLE, Frame
from panewright.plans.rewrite import Rewrites
from panewright.plans.window import WindowDef, asc
from panewright.sources import checkpointed

#: Rows in a block, about, and blocks at most; then blocks are larger.
BLOCK_ROWS, MOST_BLOCKS = 200_000, 20_000

#: How values of two parts of a frame make that of both.
_COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}
_FOLD = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _check(name: str, e: Node) -> None:
    if isinstance(e, Ranking):
        if e.build not in (F.row_number, F.rank, F.dense_rank):
            raise ValueError(f"{name}: of the ranking functions row_number, rank and dense_rank can be spread")
    elif isinstance(e, Aggregate):
        frame = e.window.frame or WHOLE
        if frame.kind != ROWS and not frame.whole:
            raise ValueError(f"{name}: frames of rows can be spread, not of values")
        if frame.inverted:
            raise ValueError(f"{name}: the frame starts after its end")
        if None in (frame.low, frame.high) and not frame.whole and e.name not in _COMBINE:
            raise ValueError(f"{name}: over frames open at one end sum, count, min and max can be spread")
    elif not isinstance(e, Shift):
        raise ValueError(f"{name}: aggregates, shifts and rankings can be spread, one by one")


def _reach(columns: dict[str, Node]) -> tuple[int, int]:
    """How many rows before and after its block a row's frames and shifts look at."""
    ends = [0]
    for e in columns.values():
        frame = e.window.frame or WHOLE if isinstance(e, Aggregate) else Frame(ROWS, e.offset, e.offset)
        ends += [x for x in (frame.low, frame.high) if x is not None]
    return -min(ends), max(ends)


def _whole(e: Aggregate) -> Column:
    """The aggregate over a group; FIRST and LAST by position."""
    args = tuple(compiled(a, Rewrites()) for a in e.args)
    if e.name in ("first", "last"):
        return (F.min_by if e.name == "first" else F.max_by)(args[0], "__r")
    return F.count_distinct(*args) if e.name == "count_distinct" else e.make(e.name, args)


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{k}h")) for k in keys]


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"{k}h" for k in keys})


def _outside(held: DataFrame, keys: list[str], columns: dict[str, Aggregate], rows: int, reach: int, after: bool) -> DataFrame:
    """For each block what `columns` give over the partition's rows that lie before the block and its copied rows (or after them): `<name>`, one row per block."""
    slot = F.floor((F.col("__r") - reach) / rows) - 1 if after else F.floor((F.col("__r") + reach) / rows) + 1  # the first block that has the row outside
    parts = held.groupBy(*keys, slot.alias("__b")).agg(*(_whole(e).alias(n) for n, e in columns.items())).withColumn("__block", F.lit(False))
    blocks = held.groupBy(*keys, F.floor(F.col("__r") / rows).alias("__b")).agg(F.count(F.lit(1)).alias("__c")).drop("__c").withColumn("__block", F.lit(True))
    w = Window.partitionBy(*keys).orderBy(F.col("__b").desc() if after else F.col("__b"), "__block").rowsBetween(Window.unboundedPreceding, 0)
    every = parts.unionByName(blocks, allowMissingColumns=True)
    return every.withColumns({n: _FOLD[e.name](n).over(w) for n, e in columns.items()}).where("__block").drop("__block")


def _by_blocks(held: DataFrame, keys: list[str], columns: dict[str, Node], block_rows: int, use: Rewrites) -> DataFrame:
    """`held` (with the position `__r` in its partition) with `columns`."""
    before, behind = _reach(columns)
    rows = max(block_rows, before, behind)
    frame = {n: e.window.frame or WHOLE if isinstance(e, Aggregate) else None for n, e in columns.items()}
    whole = {n: e for n, e in columns.items() if frame[n] is not None and frame[n].whole}
    opening = {n: e for n, e in columns.items() if frame[n] is not None and frame[n].low is None and n not in whole}
    closing = {n: e for n, e in columns.items() if frame[n] is not None and frame[n].high is None and n not in whole}

    own, at = F.floor(F.col("__r") / rows), F.col("__r") % rows
    copies = [own, *([F.when(at >= rows - before, own + 1)] if before else []), *([F.when((at < behind) & (own > 0), own - 1)] if behind else [])]
    spread = held.withColumn("__b", F.explode(F.array_compact(F.array(*copies)))) if len(copies) > 1 else held.withColumn("__b", own)
    local = {}
    for n, e in columns.items():
        if n not in whole:
            w = WindowDef((*keys, "__b"), (asc("__r"),), frame[n])
            local[f"__v_{n}"] = replace(e, window=w).col(use)
    out = spread.withColumns(local).where(F.col("__b") == own) if local else spread
    for part, after in ((opening, False), (closing, True)):
        if part:
            outside = _outside(held, keys, {f"__x_{n}": e for n, e in part.items()}, rows, behind if after else before, after)
            out = out.join(F.broadcast(_renamed(outside, [*keys, "__b"])), [*_same(keys), F.col("__b") == F.col("__bh")], "left").drop(*(f"{k}h" for k in [*keys, "__b"]))
            out = out.withColumns({f"__v_{n}": _COMBINE[e.name](F.col(f"__x_{n}"), F.col(f"__v_{n}")) for n, e in part.items()}).drop(*(f"__x_{n}" for n in part))
    if whole:
        total = held.groupBy(*keys).agg(*(_whole(e).alias(f"__v_{n}") for n, e in whole.items()))  # as many rows as hot keys
        out = out.join(F.broadcast(_renamed(total, keys)), _same(keys), "left").drop(*(f"{k}h" for k in keys))
    return out.drop("__b").withColumnsRenamed({f"__v_{n}": n for n in columns})


def _positions(hot: DataFrame, keys: list[str], order: list[Column], blocks: int) -> DataFrame:
    """`hot` with `__r`, each row's position from 0 in its partition's order, kept in the shared folder."""
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order]
    sorted_ = hot.repartitionByRange(blocks, *by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id())
    held = checkpointed(sorted_)
    part, index = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counted = held.groupBy(*keys, part.alias("__p")).agg(F.min(index).alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(*keys, "__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low")).alias("__start"))
    joined = held.withColumn("__p", part).join(F.broadcast(_renamed(starts, [*keys, "__p"])), [*_same(keys), F.col("__p") == F.col("__ph")])
    return joined.withColumn("__r", index + F.col("__start")).drop("__m", "__p", "__ph", "__start", *(f"{k}h" for k in keys))


def spread(df: DataFrame, w: WindowDef, columns: dict[str, Node], share: Fraction = Fraction(1, 50), block_rows: int = BLOCK_ROWS, use: Rewrites | None = None) -> DataFrame:
    """`df` with `columns`, windowed expressions over the keys of `w` and their own frames; the same values as without spreading.

    Partitions with at least `share` of all rows are cut, and the whole table if `w` has no partition keys. Columns: aggregates over the whole partition or over
    frames of rows, of these sum, count, min and max over ones open at one end; row_number, rank and dense_rank; lead, lag and shift. The
    order must be unique, as everywhere for ROWS frames (for rank and dense_rank it needn't). Null is a value of order keys, and null partition keys are a
    partition. Columns of the table that begin with __ raise ValueError. An empty table gives no rows. Counts the keys' rows and sorts the hot ones at once.
    """
    use = use or Rewrites(unique_order=True)
    if clash := [c for c in columns if c in df.columns]:
        raise ValueError(f"the table has the columns {clash} already")
    if own := [c for c in df.columns if c.startswith("__")]:
        raise ValueError(f"columns that begin with __ are used inside; rename {own} first")
    if not w.order:
        raise ValueError("an order is needed")
    for name, e in columns.items():
        _check(name, e)
    plain = {n: replace(e, window=WindowDef(w.partition, w.order, e.window.frame if isinstance(e, Aggregate) else None)).col(use) for n, e in columns.items()}
    kinds = {f.name: f.dataType for f in df.select(*(c.alias(n) for n, c in plain.items())).schema.fields}

    parted = bool(w.partition)
    keys = [f"__k{i}" for i in range(max(len(w.partition), 1))]
    held = df.withColumns(dict(zip(keys, (compiled(c, use) for c in w.partition), strict=True)) if parted else {keys[0]: F.lit(0)})
    if parted:
        counted = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        enough = F.col("__n") * share.denominator >= counted.agg(F.sum("__n").alias("t")).scalar() * share.numerator
        hot = counted.where(enough).collect()  # at most 1 / share
        rows = sum(r["__n"] for r in hot)
    else:
        rows = held.count()
    cold = df.select("*", *(c.alias(n) for n, c in plain.items()))
    if not rows:
        return cold
    if parted:
        few = F.broadcast(_renamed(df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in hot], held.select(*keys).schema), keys))
        cold = held.join(few, _same(keys), "left_anti").select(*df.columns, *(c.alias(n) for n, c in plain.items()))
        held = held.join(few, _same(keys), "left_semi")

    block_rows = max(block_rows, -(-rows // MOST_BLOCKS))
    placed = _positions(held, keys, [k.to_column() for k in w.order], -(-rows // block_rows))
    asked: dict[str, Node] = {n: e for n, e in columns.items() if not isinstance(e, Ranking)}
    ranks = {n: e for n, e in columns.items() if isinstance(e, Ranking) and e.build is not F.row_number}
    if ranks:
        # Where a row's order keys differ from those of the row before, its peers begin.
        now = {f"__o{i}": k.column for i, k in enumerate(w.order)}
        placed = placed.withColumns({n: compiled(c, use) for n, c in now.items()})
        placed = _by_blocks(placed, keys, {f"__before{n}": Shift(WindowDef(), n, -1) for n in now}, block_rows, use)
        begins = F.col("__r") == 0
        for n in now:
            begins = begins | ~F.col(n).eqNullSafe(F.col(f"__before{n}"))
        placed = checkpointed(placed.withColumn("__begins", begins).drop(*now, *(f"__before{n}" for n in now)))
        for n, e in ranks.items():
            first = F.when(F.col("__begins"), F.col("__r") + 1)
            asked[n] = Aggregate(WindowDef(frame=RUNNING), "max", (first,), _make) if e.build is F.rank else Aggregate(WindowDef(frame=RUNNING), "count", (first,), _make)
    out = _by_blocks(placed, keys, asked, block_rows, use) if asked else placed
    values = {n: (F.col("__r") + 1 if isinstance(e, Ranking) and n not in ranks else F.col(n)).cast(kinds[n]).alias(n) for n, e in columns.items()}
    spread_ = out.select(*df.columns, *values.values())
    return cold.unionByName(spread_) if parted else spread_


def _make(name: str, args: tuple[Column, ...]) -> Column:
    return {"max": F.max, "count": F.count}[name](*args)
