"""Percentiles of very large numeric columns by mergeable summaries with relative rank error.

A summary is a stack of compactors. Each holds values of one weight, a power of two; when it is full it sorts them and passes every other value of
its lower part on at twice the weight, while its upper part, the protected tail, stays. How far a compaction reaches follows the number of trailing ones of
a counter, so that values near the tail are compacted exponentially rarely. The error of a rank is then proportional to its distance
from the protected end: for high percentiles it stays a small share of what lies above. Summaries of partitions or days merge level by level, in any
order, without loss of the guarantee.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the error bound, measured for this summary with 3 sections at the start: of the public REQ sketch of Apache DataSketches, which is built on
#: Cormode, Karnin, Liberty, Thaler, Vesely: Relative Error Streaming Quantiles (2021).
_RELATIVE, _FIXED = 0.0512, 0.084
#: Size of a section: 32 gives a rank error (three standard deviations) of at most 1.3 % of the rows above, and 0.8 % of all rows.
SECTION = 32
_FIRST_SECTIONS, _LEAST_SECTION = 3, 4


def rank_error(q: float, section: int = SECTION) -> float:
    """Bound (three standard deviations) on the error of normalised rank q, if the upper tail is protected."""
    return 3 * min(_FIXED / section, math.sqrt(_RELATIVE / _FIRST_SECTIONS) / section * (1 - q))


@dataclass
class _Level:
    """A compactor: its values (any order), the counter of its compactions, and its sections."""

    values: list[np.ndarray] = field(default_factory=list)
    n: int = 0
    state: int = 0
    size: float = SECTION
    sections: int = _FIRST_SECTIONS
    coin: bool = False

    @property
    def section(self) -> int:
        return max(2 * round(self.size / 2), _LEAST_SECTION)

    @property
    def capacity(self) -> int:
        return 2 * self.sections * self.section

    def add(self, x: np.ndarray) -> None:
        if len(x):
            self.values.append(x)
            self.n += len(x)

    def grow(self) -> None:
        """More and smaller sections once as many compactions have happened as the present ones allow."""
        while self.state >= 1 << (self.sections - 1) and round(self.size / math.sqrt(2) / 2) * 2 >= _LEAST_SECTION:
            self.size /= math.sqrt(2)
            self.sections *= 2

    def compact(self, rng: np.random.Generator) -> np.ndarray:
        """Takes the lower part out and returns every other value of it."""
        x = np.sort(np.concatenate(self.values))
        trailing_ones = (~self.state & (self.state + 1)).bit_length() - 1
        kept = self.capacity // 2 + (self.sections - min(trailing_ones + 1, self.sections)) * self.section
        cut = max(len(x) - kept, 0)
        cut -= cut % 2
        self.coin = not self.coin if self.state & 1 else bool(rng.integers(2))
        self.state += 1
        self.values, self.n = [x[cut:]], len(x) - cut
        self.grow()
        return x[int(self.coin) : cut : 2]


class Sketch:
    """A summary of numbers whose upper tail is protected. `seed` fixes its random choices, so that a repeated task gives the same result."""

    def __init__(self, section: int = SECTION, seed: int = 0) -> None:
        self.base = section
        self.levels = [_Level(size=section)]
        self.n = 0
        self.least, self.most = math.inf, -math.inf
        self.seed = seed
        self._rng: np.random.Generator | None = None

    @property
    def rng(self) -> np.random.Generator:
        """Made when the first choice is due: most summaries of small groups never need one."""
        if self._rng is None:
            self._rng = np.random.default_rng(self.seed)
        return self._rng

    def update(self, x: np.ndarray) -> None:
        """Adds finite numbers. In blocks, so that a large array doesn't swell the first compactor."""
        for low in range(0, len(x), 8192):
            part = x[low : low + 8192] if len(x) > 8192 else x
            self.levels[0].add(part)
            self.n += len(part)
            self._settle()
        if len(x):
            self.least, self.most = min(self.least, float(x.min())), max(self.most, float(x.max()))

    def _settle(self) -> None:
        for h in range(64):
            if h == len(self.levels):
                return
            level = self.levels[h]
            while level.n >= level.capacity:
                if h + 1 == len(self.levels):
                    self.levels.append(_Level(size=self.base))
                self.levels[h + 1].add(level.compact(self.rng))

    def merge(self, other: Sketch) -> None:
        while len(self.levels) < len(other.levels):
            self.levels.append(_Level(size=self.base))
        for mine, theirs in zip(self.levels, other.levels, strict=False):
            mine.state |= theirs.state
            if mine.state:
                mine.coin = bool(self.rng.integers(2))  # of two parents' coins neither pairs with the next compaction
            if theirs.sections > mine.sections:
                mine.size, mine.sections = theirs.size, theirs.sections
            mine.grow()
            for x in theirs.values:
                mine.add(x)
        self.n += other.n
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        self._settle()

    def retained(self) -> int:
        return sum(x.n for x in self.levels)

    def quantiles(self, qs: list[float]) -> list[float | None]:
        """For each q the smallest held value up to which a share q of the rows lies; None if empty. 0 and 1 give the true extremes."""
        if not self.n:
            return [None] * len(qs)
        values = np.concatenate([v for x in self.levels for v in x.values])
        weights = np.concatenate([np.full(len(v), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels) for v in x.values])
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(weights[order])
        at = np.searchsorted(upto, np.ceil(np.array(qs) * self.n), side="left")
        found = values[np.minimum(at, len(values) - 1)].tolist()
        return [self.least if q <= 0 else self.most if q >= 1 else v for q, v in zip(qs, found, strict=True)]

    def to_bytes(self) -> bytes:
        head = struct.pack("<IQddH", self.base, self.n, self.least, self.most, len(self.levels))
        parts = [head]
        for x in self.levels:
            v = np.concatenate(x.values) if x.values else np.zeros(0)
            parts += [struct.pack("<QdH?I", x.state, x.size, x.sections, x.coin, len(v)), v.astype("<f8").tobytes()]
        return b"".join(parts)

    @staticmethod
    def from_bytes(data: bytes, seed: int = 0) -> Sketch:
        base, n, least, most, levels = struct.unpack_from("<IQddH", data)
        out, at = Sketch(base, seed), struct.calcsize("<IQddH")
        out.n, out.least, out.most, out.levels = n, least, most, []
        for _ in range(levels):
            state, size, sections, coin, k = struct.unpack_from("<QdH?I", data, at)
            at += struct.calcsize("<QdH?I")
            out.levels.append(_Level([np.frombuffer(data, "<f8", k, at)] if k else [], k, state, size, sections, coin))
            at += 8 * k
        return out


def _seed(*parts: object) -> int:
    import xxhash

    return xxhash.xxh32_intdigest("\x00".join(map(repr, parts)))


#: Groups that a task holds summaries of before it passes them on.
_HELD = 20_000
#: Tasks from which on their summaries are merged in two steps.
TREE_FROM = 1_000


def _codes(columns: list[tuple[np.ndarray, int]], rows: int) -> np.ndarray:
    """One number for each distinct combination of the columns' codes; a column is its codes and how many there may be."""
    out, most = np.zeros(rows, dtype=np.int64), 1
    for codes, n in columns:
        if most * n >= 1 << 62:
            distinct, out = np.unique(out, return_inverse=True)
            most = len(distinct)
        out, most = out * n + codes, most * n
    return out


def _partials(names: list[str], keysets: list[tuple[str | None, list[str]]], section: int):  # noqa: ANN202
    """Per task, summaries of the groups in its rows, for each set of key columns (after a constant, if one is given); passed on when the table is full.
    Merging makes them whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        kinds: list[pa.DataType] = []

        def passed_on() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            arrays += [pa.array([s.n for s in held.values()], pa.int64()), pa.array([s.to_bytes() for s in held.values()], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*names, "n", "sketch"])

        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(b.schema.get_field_index("v")).to_numpy(zero_copy_only=False)
            coded: dict[str, tuple[np.ndarray, list]] = {}
            for c in {c for _, columns in keysets for c in columns}:
                d = b.column(b.schema.get_field_index(c)).dictionary_encode(null_encoding="encode")
                coded[c] = (np.asarray(d.indices), d.dictionary.to_pylist())
            for constant, columns in keysets:
                lead = [] if constant is None else [constant]
                kinds[:] = [pa.string()] * len(lead) + [b.schema.field(c).type for c in columns]
                codes = _codes([(coded[c][0], len(coded[c][1])) for c in columns], len(v))
                order = np.argsort(codes, kind="stable")
                values, sorted_codes = v[order], codes[order]
                starts = np.flatnonzero(np.diff(sorted_codes, prepend=sorted_codes[0] - 1))
                keys = zip(*(map(coded[c][1].__getitem__, coded[c][0][order[starts]].tolist()) for c in columns), strict=True)
                for low, high, key in zip(starts.tolist(), [*starts[1:].tolist(), len(v)], keys, strict=True):
                    part, whole = values[low:high], (*lead, *key)
                    summary = held.get(whole)
                    if summary is None:
                        summary = held[whole] = Sketch(section, _seed(whole, len(part), float(part[0])))
                    summary.update(part)
            if len(held) > _HELD:
                yield passed_on()
        if held:
            yield passed_on()

    return run


def _merged(keys: list[str], section: int):  # noqa: ANN202
    """Summaries that come sorted by key, merged one after another: one summary is held, whatever the number of parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        whole: Sketch | None = None
        for b in batches:
            out = []
            for *raw, data in b[[*keys, "sketch"]].itertuples(index=False, name=None):
                key = tuple(None if x is None or x != x else x for x in raw)
                if whole is not None and key == now:
                    whole.merge(Sketch.from_bytes(data))
                    continue
                if whole is not None:
                    out.append((*now, whole.n, whole.to_bytes()))
                now, whole = key, Sketch.from_bytes(data, _seed(key))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "n", "sketch"])
        if whole is not None:
            yield pd.DataFrame([(*now, whole.n, whole.to_bytes())], columns=[*keys, "n", "sketch"])

    return run


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", n bigint, sketch binary"


def summaries(df: DataFrame, keys: dict[str, Column], value: Column, section: int = SECTION, each: dict[str, Column] | None = None) -> DataFrame:
    """One mergeable summary per key: the keys, `n` and `sketch`. With `each`, one per key and value of each of these columns, in one pass: the column's name is
    `field`, its value `code`, and they come before the keys.

    Every task summarises its own rows, and only summaries are shuffled. Null and NaN values are left out, and a key with no other has no row. Null keys are
    keys. Ties and repeated rows all count. An empty table gives no rows.
    """
    extra = each or {}
    columns = {**{f"__e{i}": c for i, c in enumerate(extra.values())}, **{f"__k{i}": c for i, c in enumerate(keys.values())}}
    held = df.select(*(c.alias(k) for k, c in columns.items()), value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    own = [f"__k{i}" for i in range(len(keys))]
    keysets = [(name, [f"__e{i}", *own]) for i, name in enumerate(extra)] if each else [(None, own)]
    names = [*(["field", "code"] if each else []), *keys]
    kinds = [held.schema[c].dataType.simpleString() for c in keysets[0][1]]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, [*(["string"] if each else []), *kinds], strict=True)) + ", n bigint, sketch binary"
    parts = held.mapInArrow(_partials(names, keysets, section), schema)
    tasks = held.rdd.getNumPartitions()
    if tasks >= TREE_FROM:
        # As many lots as summaries in a lot, so that no task merges one group's summaries of all tasks.
        lots = parts.withColumn("__lot", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks))))
        parts = merge_summaries(lots, [*names, "__lot"], section).drop("__lot")
    return merge_summaries(parts, names, section)


def merge_summaries(parts: DataFrame, keys: list[str], section: int = SECTION) -> DataFrame:
    """One summary per key out of any number, as of single days; by other columns than the summaries were made by, if these are fewer."""
    spread = parts.select(*keys, "n", "sketch").repartition(*keys).sortWithinPartitions(*keys, "n", F.xxhash64("sketch"))
    return spread.mapInPandas(_merged(keys, section), _schema(parts, keys))


def percentiles(merged: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """The keys, `n`, and a column for each name of `qs` with that percentile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [Sketch.from_bytes(x).quantiles(list(qs.values())) for x in b["sketch"]]
            yield pd.concat([b[[*keys, "n"]].reset_index(drop=True), pd.DataFrame(found, columns=list(qs), dtype=float)], axis=1)

    schema = _schema(merged, keys).replace(", sketch binary", "") + "".join(f", `{q}` double" for q in qs)
    return merged.mapInPandas(run, schema)
