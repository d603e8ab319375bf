"""Normalising times that come in mixed formats, precisions and zones to one moment in UTC.

Of each value all valid interpretations are generated as an array, by patterns in SQL expressions; the conventions given leave out those that
they contradict. A Viterbi pass over each source's record order then chooses one per value, penalising changes of format and steps back in time.

The pass is distributed exactly. Records are spread by ranges of source and order, so that a source of any size takes as many tasks as it
needs. A value with one interpretation separates what precedes it from what follows, so only the ambiguous stretches need work, and a task holds no more than
a chunk of records and the stretch that is open at its end. Where a source goes on in the next range, each range first reports the cheapest costs between
its outermost interpretations (a few numbers). Tasks chain these, source by source; only for ranges that begin or end with an ambiguous value, at most
MOST_RANGES, the choice is broadcast, and each range then finishes on its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panewright.sources import checkpointed

DAY_US = 86_400_000_000
#: Records in a range at least, as long as there are fewer ranges than cores keep busy; ranges at most; records that a task works on at once.
LEAST_RANGE, MOST_RANGES, CHUNK = 2_000, 20_000, 50_000
#: Stands before what a pattern has matched; a value that holds it already has no reading.
_MARK = "\x01"

#: Zone abbreviations of the USA and UTC's names, in seconds from UTC.
ABBREVIATIONS = {
    "AKDT": -28800, "AKST": -32400, "ADT": -10800, "AST": -14400, "CDT": -18000, "CST": -21600, "EDT": -14400, "EST": -18000, "GMT": 0,
    "HDT": -32400, "HST": -36000, "MDT": -21600, "MST": -25200, "PDT": -25200, "PST": -28800, "UT": 0, "UTC": 0, "Z": 0,
}

#: English names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_ZONE = r" ?(\[[A-Za-z][A-Za-z0-9_+-]*(?:/[A-Za-z0-9_+-]+)+\]|(?<= )[A-Za-z][A-Za-z0-9_+-]*(?:/[A-Za-z0-9_+-]+)+|(?:" + "|".join(sorted(ABBREVIATIONS, key=lambda x: (-len(x), x))) + r")|(?<=[0-9 Mm])[+-][0-9]{2}:?[0-9]{2})\z"
#: A value of these characters alone names no zone.
_NO_ZONE = r"\A[0-9:. ]*+\z"
_CLOCK = r"([0-9]{1,2})[:h]([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?(?: ?([AaPp])[Mm])?"
_DATED_CLOCK = rf"\A(?:([^|]*?[^| T])(?:T| +))?{_CLOCK}\z"

#: Ways to write a date: name, what tells it from others at a glance, pattern, and the groups that are year, month and day.
DATE_FORMATS = (
    ("iso", "-", r"\A([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\z", "$1-$2-$3"),
    ("compact", "", r"\A([0-9]{4})([0-9]{2})([0-9]{2})\z", "$1-$2-$3"),
    ("slash_mdy", "/", r"\A([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})\z", "$3-$1-$2"),
    ("slash_dmy", "/", r"\A([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})\z", "$3-$2-$1"),
    ("dot_dmy", ".", r"\A([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4}|[0-9]{2})\z", "$3-$2-$1"),
    ("dot_mdy", ".", r"\A([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4}|[0-9]{2})\z", "$3-$1-$2"),
    ("day_name", "a", r"\A(?:[A-Za-z]+, )?([0-9]{1,2})[ -]([A-Za-z]{3,9})[ -]([0-9]{4}|[0-9]{2})\z", "$3-$2-$1"),
    ("name_day", "a", r"\A(?:[A-Za-z]+, )?([A-Za-z]{3,9}) ([0-9]{1,2}),? ([0-9]{4})\z", "$3-$1-$2"),
)


@dataclass(frozen=True)
class Conventions:
    """Which readings of a date are admitted (None: all, the choice is left to the pass over the records), and the costs of the pass."""

    dates: tuple[str, ...] | None = None
    format_switch: float = 1.0
    step_back: float = 1.0
    step_back_day: float = 0.05


def _with_days(df: DataFrame, text: Column, rules: Conventions) -> tuple[DataFrame, list[int]]:
    """Adds `__f<i>` and `__d<i>`, the format and the days since 1970 of the i-th reading of a date; null where there is none.

    The patterns exclude each other but for those that swap day and month, so a text has two readings at most, the second of which is given only
    where it is another day. Flat expressions, no arrays, so that Spark compiles them.
    """
    admitted = [x for x in DATE_FORMATS if rules.dates is None or x[0] in rules.dates]
    readings: list[dict[str, tuple[str, str, str]]] = [{}, {}]
    for name, glance, pattern, to in admitted:
        readings[pattern in readings[0]][pattern] = (name, glance, to)
    used = [i for i, r in enumerate(readings) if r]
    names = F.create_map(*(F.lit(v) for i, n in enumerate(MONTHS, 1) for key in dict.fromkeys((n, n[:3])) for v in (key, str(i))))
    glances = {"/": text.contains("/"), ".": text.contains("."), "a": text.rlike("[A-Za-z]"), "-": text.contains("-"), "": F.lit(True)}
    for i in used:
        # Each text meets the patterns of its own kind only; one that matches marks its reading.
        read = None
        for glance, is_so in glances.items():
            found = text
            for p, (n, g, to) in readings[i].items():
                if g == glance:
                    next_ = F.regexp_replace(text, p, f"{_MARK}{n}-{to}")
                    found = next_ if found is text else F.when(found.startswith(_MARK), found).otherwise(next_)
            read = F.when(is_so, found) if read is None else read.when(is_so, found)
        df = df.withColumn(f"__said{i}", read)
        said = F.when(F.col(f"__said{i}").startswith(_MARK), F.substring(f"__said{i}", 2, 2**31 - 1))
        df = df.withColumn(f"__s{i}", F.split(said, "-"))
        y, m, d = (F.col(f"__s{i}")[k] for k in (1, 2, 3))
        month = F.when(m.rlike("[A-Za-z]"), F.coalesce(F.try_element_at(names, F.lower(m)), F.lit("0"))).otherwise(m)
        year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
        day = F.unix_date(F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")).cast("bigint")
        if i:
            day = F.when(~day.eqNullSafe(F.col("__d0")), day)
        df = df.withColumn(f"__d{i}", day).withColumn(f"__f{i}", F.col(f"__s{i}")[0])
    return df, used


def candidates(df: DataFrame, value: str, date: str, zone: str, rules: Conventions, zones: list[str]) -> DataFrame:
    """`df` with `candidates`, an array of struct<format, status, moment>: all that `value` may mean.

    value: text of a time, with or without date and zone. date: text of the day that a bare time of day belongs to. zone: name of the zone of a
    time without any. status is `ok` (moment: microseconds since 1970), `gap` (the wall-clock time doesn't occur: moment is null) or `overlap` (it occurs
    twice: an entry for each moment). The array is empty for null, for what is no valid date or time, for a time of day without a
    valid date, and for a wall-clock time without a zone that is known.
    """
    outer = set(df.columns)
    v = F.trim(F.col(value))
    v = F.when(~v.contains(_MARK), v)
    df = df.withColumn("__v", v)
    marked = F.when(F.col("__v").rlike(_NO_ZONE), F.col("__v")).otherwise(F.regexp_replace("__v", _ZONE, f"{_MARK}$1"))
    df = df.withColumn("__zoned", F.split(marked, _MARK))
    df = df.withColumns({"__b": F.col("__zoned")[0], "__z": F.coalesce(F.get("__zoned", F.lit(1)), F.lit(""))})
    b = F.col("__b")
    # mark|date|hour|minute|second|fraction|half of the day
    digits, four, long = b.rlike(r"\A[0-9]++\z"), F.lpad(b, 4, "0"), F.length(b)
    fields = lambda at, *widths: F.concat_ws("|", F.lit(_MARK), *(F.substring(b, a, w) for a, w in zip(at, widths, strict=True)), F.lit(""), F.lit(""))
    read = (
        F.when(digits, F.when(long <= 4, F.concat(F.lit(f"{_MARK}||"), F.substring(four, 1, 2), F.lit("|"), F.substring(four, 3, 2), F.lit("|||"))).when(long == 14, fields((1, 9, 11, 13), 8, 2, 2, 2)))
        .when((long == 15) & b.rlike(r"\A[0-9]{8}T[0-9]{6}\z"), fields((1, 10, 12, 14), 8, 2, 2, 2))
        .otherwise(F.regexp_replace(b, _DATED_CLOCK, f"{_MARK}|$1|$2|$3|$4|$5|$6"))
    )
    df = df.withColumns({"__read": read, "__digits": digits})
    df = df.withColumn("__p", F.when(F.col("__read").startswith(_MARK), F.split(F.substring("__read", 3, 2**31 - 1), r"\|")))
    p = F.col("__p")
    written = F.when(F.col("__digits"), F.when(long <= 4, "bare").otherwise("digits")).when((long == 15) & b.rlike(r"\A[0-9]{8}T"), "digits").when(p[0] == "", "clock").otherwise("dated")
    # Only digits are cast: a failed cast costs an exception.
    hour, minute, second = (F.coalesce(F.when(p[i] != "", p[i].try_cast("int")), F.lit(0)) for i in (1, 2, 3))
    micro = F.rpad(F.substring(p[4], 1, 6), 6, "0").try_cast("int")
    half = F.lower(p[5])
    end_of_day = (hour == 24) & (minute == 0) & (second == 0) & (micro == 0)
    sound = (minute < 60) & (second < 60) & F.when(half == "", (hour < 24) | end_of_day).otherwise(hour.between(1, 12))
    h = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    time_of_day = F.when(sound, ((h * 3600 + minute * 60 + second).cast("bigint") * 1_000_000) + micro)
    day_text = F.when(p[0] == "", F.trim(F.col(date))).otherwise(p[0])
    df = df.withColumn("__t", time_of_day).withColumn("__day", F.when(F.col("__t").isNotNull(), day_text))
    df, readings = _with_days(df, F.col("__day"), rules)

    z = F.col("__z")
    offsets = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    numeric = z.rlike(r"\A[+-]")
    digits = F.replace(z, F.lit(":"), F.lit(""))
    hours, minutes = (F.when(numeric, F.substring(digits, at, 2).try_cast("int")) for at in (2, 4))
    signed = F.when((hours <= 18) & (minutes < 60), (hours * 3600 + minutes * 60) * F.when(z.startswith("-"), -1).otherwise(1))
    fixed = F.when(numeric, signed).when(z != "", F.try_element_at(offsets, z))
    named = F.when(z == "", F.col(zone)).when(z.contains("/"), F.regexp_replace(z, r"[\[\]]", ""))
    df = df.withColumns({"__off": fixed.cast("bigint") * 1_000_000, "__name": F.when(named.isin(*zones), named)})

    wall = lambda u: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(u), F.col("__name")))
    entry = lambda form, status, moment: F.struct(form.alias("format"), F.lit(status).alias("status"), moment.cast("bigint").alias("moment"))
    entries = []
    for i in readings:
        # The zone's offsets a day before and after give the moments that the wall-clock time may be; those count that read as it.
        local, before, after, form = (F.col(f"__{c}{i}") for c in ("l", "u", "w", "form"))
        df = df.withColumns({f"__l{i}": F.col(f"__d{i}") * DAY_US + F.col("__t"), f"__form{i}": F.concat_ws("/", f"__f{i}", written)})
        df = df.withColumns({f"__u{i}": local * 2 - DAY_US - wall(local - DAY_US), f"__w{i}": local * 2 + DAY_US - wall(local + DAY_US)})
        steady = before == after
        df = df.withColumns({f"__ub{i}": steady | (wall(before) == local), f"__wb{i}": ~steady & (wall(after) == local)})
        is_before, is_after, twice = F.col(f"__ub{i}"), F.col(f"__wb{i}"), F.col(f"__ub{i}") & F.col(f"__wb{i}")
        placed = F.col("__off").isNull() & F.col("__name").isNotNull() & local.isNotNull()
        entries += [
            F.when(F.col("__off").isNotNull() & local.isNotNull(), entry(form, "ok", local - F.col("__off"))),
            F.when(placed & is_before & ~twice, entry(form, "ok", before)), F.when(placed & is_after & ~twice, entry(form, "ok", after)),
            F.when(placed & twice, entry(form, "overlap", before)), F.when(placed & twice, entry(form, "overlap", after)),
            F.when(placed & ~is_before & ~is_after, entry(form, "gap", F.lit(None))),
        ]
    epoch = F.when((z == "") & F.col("__digits") & long.isin(10, 13, 16), F.rpad(b, 16, "0").cast("bigint"))
    df = df.withColumn("__e", epoch)
    entries.append(F.when(F.col("__e").isNotNull(), entry(F.lit("epoch"), "ok", F.col("__e"))))
    kept = [c for c in df.columns if not c.startswith("__") or c in outer]
    return df.select(*kept, F.array_compact(F.array(*entries)).alias("candidates"))


def known_zones(df: DataFrame) -> list[str]:
    """Zone names that the JVM knows."""
    return sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())


def utc_text(micros: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSSSSZ, whatever the session's zone."""
    us = F.pmod(micros, F.lit(DAY_US))
    day = F.date_from_unix_date(((micros - us) / DAY_US).cast("int")).cast("string")
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    seconds = (us - us % 1_000_000) / 1_000_000
    hour, minute, second = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.concat(day, F.lit("T"), two(hour), F.lit(":"), two(minute), F.lit(":"), two(second), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0"), F.lit("Z"))


State = tuple[str, int | None]


def _costs(a: list[State], b: list[State], rules: Conventions) -> np.ndarray:
    """What stepping from each state of a record to each of the next costs."""
    out = np.zeros((len(a), len(b)))
    for i, (f, t) in enumerate(a):
        for j, (g, u) in enumerate(b):
            out[i, j] = rules.format_switch * (f != g)
            if t is not None and u is not None and u < t:
                out[i, j] += rules.step_back + rules.step_back_day * (t - u) / DAY_US
    return out


def best_path(states: list[list[State]], rules: Conventions) -> list[int]:
    """Viterbi: the cheapest choice of one state for each record in order; the earlier entry where costs tie."""
    if not states:
        return []
    cost, back = np.zeros(len(states[0])), []
    for a, b in zip(states, states[1:], strict=False):
        step = cost[:, None] + _costs(a, b, rules)
        back.append(step.argmin(axis=0))
        cost = step.min(axis=0)
    path = [int(cost.argmin())]
    for come_from in reversed(back):
        path.append(int(come_from[path[-1]]))
    return path[::-1]


class _Records:
    """Records in the order of source and order, with their states where there are any."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table
        found = table.column("candidates").combine_chunks()
        self.lengths = np.asarray(found.value_lengths().fill_null(0))
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        flat = found.flatten()
        self.formats, self.moments = flat.field("format"), flat.field("moment")
        self.source = table.column("__source").combine_chunks()
        codes = np.asarray(self.source.dictionary_encode(null_encoding="encode").indices)
        at = np.flatnonzero(self.lengths > 0)
        self.segments = np.split(at, np.flatnonzero(np.diff(codes[at])) + 1) if len(at) else []

    def states(self, row: int) -> list[State]:
        return [(self.formats[k].as_py(), self.moments[k].as_py()) for k in range(self.offsets[row], self.offsets[row + 1])]

    def choose(self, segment: np.ndarray, start: int | None, end: int | None, rules: Conventions, picks: np.ndarray) -> None:
        """Fills `picks` for a segment whose outermost choices may be given."""
        fixed = self.lengths[segment] == 1
        for given, at in ((start, 0), (end, -1)):
            if given is not None:
                picks[segment[at]], fixed[at] = given, True
        for run in np.split(np.flatnonzero(~fixed), np.flatnonzero(np.diff(np.flatnonzero(~fixed)) > 1) + 1):
            if not len(run):
                continue
            low, high = max(run[0] - 1, 0), min(run[-1] + 1, len(segment) - 1)
            rows = segment[low : high + 1]
            options = [list(range(self.lengths[r])) if not fixed[low + i] else [int(picks[r])] for i, r in enumerate(rows)]
            path = best_path([[self.states(r)[k] for k in o] for r, o in zip(rows, options, strict=True)], rules)
            for r, o, k in zip(rows, options, path, strict=True):
                picks[r] = o[k]


class _Outline:
    """Of a source's records in a range: the first and last states and the cheapest costs between them, up to a constant. Records between two values of one
    interpretation don't matter, so that only those before the first and after the last such value are looked at."""

    def __init__(self, source: str | None, rules: Conventions) -> None:
        self.source, self.rules = source, rules
        self.first: list[State] = []
        self.last: list[State] = []
        self.head: np.ndarray | None = None
        self.cost = np.zeros((0, 0))

    def add(self, records: _Records, segment: np.ndarray) -> None:
        single = np.flatnonzero(records.lengths[segment] == 1)
        if len(single):
            upto = segment[: single[0] + 1] if self.head is None else segment[:0]
            for r in upto:
                self._push(records.states(r))
            self.head = self.cost[:, 0] if self.head is None else self.head
            self.last, self.cost = records.states(segment[single[-1]]), np.zeros((1, 1))
            segment = segment[single[-1] + 1 :]
        for r in segment:
            self._push(records.states(r))

    def _push(self, states: list[State]) -> None:
        if not self.first:
            self.first, self.cost = states, np.where(np.eye(len(states), dtype=bool), 0.0, np.inf)
        else:
            self.cost = (self.cost[:, :, None] + _costs(self.last, states, self.rules)[None]).min(axis=1)
        self.last = states

    def costs(self) -> list[list[float]]:
        return (self.cost if self.head is None else self.head[:, None] + self.cost[0][None]).tolist()


def _chain(parts: list[dict], rules: Conventions) -> list[tuple[int, int]]:
    """Of one source's segments in their order the chosen first and last states."""
    # The joint choice (first, last) of a segment is one state of this chain.
    joint = [[(i, j) for i in range(len(x["first"])) for j in range(len(x["last"]))] for x in parts]
    own = [np.array([x["cost"][i][j] for i, j in o]) for x, o in zip(parts, joint, strict=True)]
    cost, back = own[0], []
    for k in range(1, len(parts)):
        step = _costs([tuple(s) for s in parts[k - 1]["last"]], [tuple(s) for s in parts[k]["first"]], rules)
        whole = np.array([[cost[a] + step[la, fb] for fb, _ in joint[k]] for a, (_, la) in enumerate(joint[k - 1])])
        back.append(whole.argmin(axis=0))
        cost = whole.min(axis=0) + own[k]
    at, out = int(cost.argmin()), []
    for k in range(len(parts) - 1, -1, -1):
        out.append(joint[k][at])
        at = int(back[k - 1][at]) if k else at
    return out[::-1]


def _ends(outlines: DataFrame, rules: Conventions) -> DataFrame:
    """The choice at a range's start (`end` 0) or end (1), where it is ambiguous and the source goes on beyond. A task chains a source: two rows a range at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["range", "segment"])
        parts = [json.loads(x) for x in pdf["said"]]
        rows = []
        if any(len(x["first"]) > 1 or len(x["last"]) > 1 for x in parts):
            for x, number, (i, j) in zip(parts, pdf["range"], _chain(parts, rules), strict=True):
                rows += [(number, 0, i)] * (x["is_first"] and len(x["first"]) > 1) + [(number, 1, j)] * (x["is_last"] and len(x["last"]) > 1)
        return pd.DataFrame(rows, columns=["range", "end", "pick"]).astype("int32")

    return outlines.groupBy("source").applyInPandas(run, "range int, end int, pick int")


@contextmanager
def _small_methods(spark: SparkSession) -> Iterator[None]:
    """While the expressions are planned and run: in pieces that the JVM compiles. As one method they would be too long for it and be interpreted, at twice the
    time."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def choose(df: DataFrame, source: Column, order: Column, rules: Conventions, rows_per_range: int = CHUNK, prepare=None) -> DataFrame:  # noqa: ANN001
    """`df` with `pick`: of each record's `candidates` the position (from 0) on its source's cheapest path; null where there are none.

    `prepare` may add the candidates once the records are in ranges, so that they aren't shuffled. Nulls are a source of their own. Records that tie
    in `order` stay in some order. A task holds CHUNK records and the ambiguous ones since the last unambiguous one. An empty table gives no rows. Reads the table at once.
    """
    spark, rows = df.sparkSession, df.count()
    ranges = min(max(1, -(-rows // rows_per_range), min(3 * spark.sparkContext.defaultParallelism, rows // LEAST_RANGE)), MOST_RANGES)
    keyed = df.withColumns({"__source": source.cast("string"), "__order": order})
    spread = keyed.repartitionByRange(ranges, "__source", "__order").sortWithinPartitions("__source", "__order")
    with _small_methods(spark):
        held = checkpointed(prepare(spread) if prepare else spread)

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = now = None
        count = 0
        for b in batches:
            records = _Records(pa.Table.from_batches([b]))
            for segment in records.segments:
                of = records.source[int(segment[0])].as_py()
                if now is None or of != now.source:
                    first, now, count = first or now, _Outline(of, rules), count + 1
                now.add(records, segment)
        if now is None:
            return
        parts = [now] if first is None else [first, now]
        said = [json.dumps({"first": x.first, "last": x.last, "cost": x.costs(), "is_first": k == 0, "is_last": k == len(parts) - 1}) for k, x in enumerate(parts)]
        number = pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([x.source for x in parts], pa.string()), number, pa.array(range(len(parts)), pa.int32()), pa.array(said)], names=["source", "range", "segment", "said"])

    said = held.select("__source", "candidates").mapInArrow(outlines, "source string, range int, segment int, said string")
    found = _ends(said, rules).collect() if ranges > 1 else []  # at most two a range
    ends = spark.sparkContext.broadcast({(r["range"], r["end"]): r["pick"] for r in found})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at_start = TaskContext.get().partitionId(), True
        kept: list[pa.Table] = []
        enough = CHUNK

        def settled(table: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
            """Chooses up to the last record of one interpretation, which starts the next chunk, or to the end of the range."""
            nonlocal at_start, enough
            records = _Records(table)
            single = np.flatnonzero(records.lengths == 1)
            upto = table.num_rows if whole else int(single[-1]) if len(single) else 0
            if not upto:
                kept[:], enough = [table], 2 * table.num_rows
                return
            if not whole:
                records = _Records(table.slice(0, upto + 1))
            picks = np.where(records.lengths > 0, 0, -1).astype(np.int32)
            for k, s in enumerate(records.segments):
                start = ends.value.get((number, 0)) if at_start and k == 0 else None
                end = ends.value.get((number, 1)) if whole and k == len(records.segments) - 1 else None
                if (records.lengths[s] > 1).any():
                    records.choose(s, start, end, rules, picks)
            at_start = at_start and not records.segments
            out = table.slice(0, upto).append_column("pick", pa.array(picks[:upto], pa.int32(), mask=picks[:upto] < 0))
            kept[:], enough = [table.slice(upto)], CHUNK
            yield from out.to_batches(max_chunksize=CHUNK)

        for b in batches:
            kept.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in kept) >= enough:
                yield from settled(pa.concat_tables(kept), False)
        if kept and sum(t.num_rows for t in kept):
            yield from settled(pa.concat_tables(kept), True)

    schema = T.StructType([*held.schema.fields, T.StructField("pick", T.IntegerType())])
    return held.mapInArrow(finish, schema).drop("__source", "__order")


def normalise(
    df: DataFrame, record_id: str, source: Column, date: str, values: tuple[str, ...], zone: str, rules: Conventions, rows_per_range: int = CHUNK,
) -> DataFrame:
    """One row per record and value column: `record_id`, `field`, `value`, `n_interpretations`, `format`, `status`, `moment` (text) and `micros`.

    Each source (with each value column) is one sequence in the order of `record_id`. `status` is null where a value names no time, `gap` and
    `overlap` where its wall-clock time occurs never or twice in its zone; for `overlap` the moment is that of the path chosen. Rows that repeat
    come out repeatedly. An empty table gives no rows.
    """
    zones = known_zones(df)
    entries = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in values)))
    long = df.select(F.col(record_id).alias("__id"), source.alias("__of"), F.col(date).cast("string").alias("__date"), F.col(zone).alias("__zone"), entries.alias("e"))
    long = long.select("__id", "__of", "__date", "__zone", "e.*")
    of = F.concat_ws("|", "field", F.coalesce(F.concat(F.lit("="), F.col("__of").cast("string")), F.lit("")))
    picked = choose(long, of, F.col("__id"), rules, rows_per_range, lambda x: candidates(x, "value", "__date", "__zone", rules, zones))
    chosen = F.when(F.col("pick").isNotNull(), F.get("candidates", F.col("pick")))
    out = picked.withColumn("c", chosen)
    return out.select(
        F.col("__id").alias(record_id), "field", "value", F.size("candidates").alias("n_interpretations"), "c.format", "c.status",
        utc_text(F.col("c.moment")).alias("moment"), F.col("c.moment").alias("micros"),
    )
