"""Setting apart delimited records that fail to parse, with each reason, while the others are loaded.

Records without quotes are split at their commas; only those with quotes meet the linear-time pattern of sound ones. Of the checked fields, each distinct value is
cast and judged once: an aggregation gives the distinct values of every checked column and how often they occur, the rules are applied to its rows, and
what is invalid makes a dictionary with the reason, which is joined back to the records beside the structural checks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewright.sources import checkpointed

#: One field: quoted with doubled quotes inside, or without any quote or comma. Possessive, so that long fields neither recurse nor backtrack.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_SOUND = rf"\A{_FIELD}(?:,{_FIELD})*+\z"

#: A dictionary of at most so many values and characters is broadcast; a larger one is joined by a salted shuffle.
BROADCAST_VALUES, BROADCAST_CHARS, SALTS = 100_000, 8_000_000, 16


@dataclass(frozen=True)
class Layout:
    """What a feed's records hold: their fields in order, and for those checked the rule that says of a trimmed value whether it is valid."""

    fields: tuple[str, ...]
    valid: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


def whole_number(v: Column) -> Column:
    """The number that ASCII digits, with an optional point and one or more zeros, say; NULL for anything else or over 18 digits."""
    digits = F.regexp_replace(F.regexp_replace(v, r"\.0+\z", ""), r"\A0+(?=.)", "")
    return F.when(v.rlike(r"\A[0-9]+(?:\.0+)?\z") & (F.length(digits) <= 18), digits.try_cast("bigint"))


def is_null(v: Column) -> Column:
    return v.isin("", "NA")


def hhmm_or_null(v: Column) -> Column:
    n = whole_number(v)
    return is_null(v) | F.coalesce(n.between(0, 2400) & (n % 100 < 60), F.lit(False))


def minutes_or_null(v: Column) -> Column:
    return is_null(v) | F.coalesce(whole_number(v).between(0, 2880), F.lit(False))


def yes_or_no(v: Column) -> Column:
    return F.upper(v).isin("YES", "NO")


@dataclass(frozen=True)
class Parsed:
    """`failures`: the id, and each reason; a record has one structural reason, or one per invalid field. `loaded`: by feed, its sound records,
    the id and all fields as unquoted strings. `dictionary`: of each invalid value its feed, column, reason and how often it occurs (`n`)."""

    failures: DataFrame
    loaded: dict[str, DataFrame]
    dictionary: DataFrame


def parse(df: DataFrame, record_id: str, feed: str, line: str, layouts: dict[str, Layout]) -> Parsed:
    """Splits the records of `df` by `layouts`.

    Reasons: `quoting` (a quote inside an unquoted field, an unclosed quoted field, anything but a comma after a closing quote), else `columns`
    (not the layout's number of fields; a null or empty line has one field), else the name of each invalid field. A record of a null or unlisted feed fails
    with `feed`. A line break inside a record is part of a field. Spaces (U+0020) around a checked value don't count. Repeated ids stay separate
    rows. An empty table gives empty results. Other columns are left out.
    """
    text = F.coalesce(F.col("__line"), F.lit(""))
    raw = df.select(F.col(record_id).alias("__id"), F.col(feed).alias("__feed"), F.col(line).alias("__line"))
    known = F.coalesce(F.col("__feed").isin(*layouts), F.lit(False))
    quoted = F.when(text.rlike(_SOUND), F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(f",({_FIELD})"), F.lit(1)))
    held = raw.withColumn("__fields", F.when(known, F.when(text.contains('"'), quoted).otherwise(F.split(text, ","))))
    width = F.coalesce(*(F.when(F.col("__feed") == name, len(x.fields)) for name, x in layouts.items()), F.lit(0))
    reason = F.when(~known, "feed").when(F.col("__fields").isNull(), "quoting").when(F.size("__fields") != width, "columns")
    judged = held.withColumn("__reason", reason)
    structural = judged.where("__reason is not null").select(F.col("__id").alias(record_id), F.col("__reason").alias("reason"))
    sound = judged.where("__reason is null")

    checked = [(name, c, x.fields.index(c), rule) for name, x in layouts.items() for c, rule in x.valid.items()]
    entries = F.array(*(F.when(F.col("__feed") == name, F.struct(F.lit(name).alias("feed"), F.lit(c).alias("column"), _value(F.col("__fields")[i]).alias("value"))) for name, c, i, _ in checked))
    if not checked:
        none = df.sparkSession.createDataFrame([], "feed string, column string, value string, reason string, n bigint")
        return Parsed(structural, {name: _fields(sound, record_id, name, x) for name, x in layouts.items()}, none)
    values = sound.select("__id", F.explode(F.array_compact(entries)).alias("e")).select("__id", "e.*")
    invalid = checkpointed(_dictionary(values, checked))
    n, chars = invalid.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("value")), F.lit(0))).first()
    small = n <= BROADCAST_VALUES and chars <= BROADCAST_CHARS

    on = ["feed", "column", "value"]
    said = invalid.select(*on, F.col("reason").alias("__said"))
    salt = F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int")
    salted = said.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    if small:
        # One pass: a structural reason takes the place of a record's values.
        whole = F.when(F.col("__reason").isNotNull(), F.array(F.struct(*(F.lit(None).cast("string").alias(c) for c in on))))
        every = judged.select("__id", "__reason", F.explode(F.coalesce(whole, F.array_compact(entries))).alias("e")).select("__id", "__reason", "e.*")
        found = every.join(F.broadcast(said), on, "left").select("__id", F.coalesce("__reason", "__said").alias("reason"))
        failures = found.where("reason is not null").select(F.col("__id").alias(record_id), "reason")
    else:
        hit = values.withColumn("salt", salt).join(salted, [*on, "salt"])
        failures = structural.unionByName(hit.select(F.col("__id").alias(record_id), F.col("__said").alias("reason")))

    loaded = {}
    for name, x in layouts.items():
        rows = sound.where(F.col("__feed") == name)
        for c in x.valid:
            own = (F.col("feed") == name) & (F.col("column") == c)
            value = _value(F.col("__fields")[x.fields.index(c)])
            if small:
                rows = rows.join(F.broadcast(said.where(own).select(F.col("value").alias("__bad"))), value == F.col("__bad"), "left_anti")
            else:
                rows = rows.join(salted.where(own).select(F.col("value").alias("__bad"), F.col("salt").alias("__salt")), (value == F.col("__bad")) & (salt == F.col("__salt")), "left_anti")
        loaded[name] = _fields(rows, record_id, name, x)
    return Parsed(failures, loaded, invalid)


def _dictionary(values: DataFrame, checked: list[tuple]) -> DataFrame:
    """The invalid ones of the distinct `feed`, `column` and `value`, with `reason` and `n`. The condition also asks for the count, always true, as Spark would
    otherwise judge every record's values before it makes them distinct."""
    distinct = values.groupBy("feed", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    reason = F.coalesce(*(F.when((F.col("feed") == name) & (F.col("column") == c) & ~ok(F.col("value")), F.lit(c)) for name, c, _, ok in checked))
    return distinct.withColumn("reason", F.when(F.col("n") > 0, reason)).where("reason is not null").select("feed", "column", "value", "reason", "n")


def _unquoted(f: Column) -> Column:
    return F.when(f.startswith('"'), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)


def _value(f: Column) -> Column:
    return F.trim(_unquoted(f))


def _fields(rows: DataFrame, record_id: str, name: str, layout: Layout) -> DataFrame:
    out = (_unquoted(F.col("__fields")[i]).alias(c) for i, c in enumerate(layout.fields))
    return rows.where(F.col("__feed") == name).select(F.col("__id").alias(record_id), *out)
