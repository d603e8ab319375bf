"""Queries of the data preparation operators of the core, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panewright.operators.malformed import Layout, Parsed, hhmm_or_null, is_null, minutes_or_null, parse, whole_number, yes_or_no
from panewright.operators.skew import heavy_keys, per_key
from panewright.operators.timestamps import ABBREVIATIONS, MONTHS, Conventions, normalise
from panewright.operators.trailing import rolling
from panewright.sources import code, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ON_TIME, ALL_YEARS = "on_time_on_time_performance_2015_3", "allyears2k_headers"
FIRST_DAY, LAST_DAY = date(2015, 1, 1), date(2015, 3, 31)


#: The fields of a record by feed.
ON_TIME_FIELDS = ("Origin", "Dest", "UniqueCarrier", "FlightNum", "TailNum", "FlightDate", "CRSDepTime", "DepTime", "DepDelayMinutes", "DepDel15", "Remark")
ALL_YEARS_FIELDS = ("Year", "Month", "DayofMonth", "Deptime", "UniqueCarrier", "FlightNum", "IsDepDelayed", "TailNum", "Origin", "Dest", "Remark")
LAYOUTS = {
    "on_time": Layout(ON_TIME_FIELDS, {"DepTime": hhmm_or_null, "DepDelayMinutes": minutes_or_null}),
    "allyears": Layout(ALL_YEARS_FIELDS, {"IsDepDelayed": yes_or_no}),
}


def _parsed(spark: SparkSession, d: str) -> Parsed:
    return parse(table(spark, d, "raw_flight_lines"), "line_id", "feed", "line", LAYOUTS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).failures


def _text(c: str):  # noqa: ANN202
    v = F.trim(F.col(c))
    return F.when(~is_null(v), v)


def p1_on_time(spark: SparkSession, d: str) -> DataFrame:
    """The sound lines of feed on_time with the on-time table's types; a date or number that is none is null."""
    rows = _parsed(spark, d).loaded["on_time"]
    numbers = ("CRSDepTime", "DepTime", "DepDelayMinutes", "DepDel15")
    typed = {c: whole_number(F.trim(F.col(c))).try_cast("int") for c in numbers} | {c: _text(c) for c in ON_TIME_FIELDS if c not in numbers}
    typed["FlightDate"] = _text("FlightDate").try_cast("date")
    return rows.select("line_id", *(typed[c].alias(c) for c in ON_TIME_FIELDS))


def p1_all_years(spark: SparkSession, d: str) -> DataFrame:
    """The sound lines of feed allyears with the all-years table's columns, strings as a CSV reader gives them; empty is null."""
    rows = _parsed(spark, d).loaded["allyears"]
    return rows.select("line_id", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in ALL_YEARS_FIELDS))


QUERIES |= {"p1_found": p1_found, "p1_on_time": p1_on_time, "p1_all_years": p1_all_years}
_SQL_LINES = """with l as (select line_id, feed, regexp_full_match(line, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') as sound,
 list_transform(regexp_extract_all(',' || line, '(?s),((?:"(?:[^"]|"")*"|[^",]*))', 1), lambda f: case when starts_with(f, '"') then replace(f[2:-2], '""', '"') else f end) as fs
 from (select line_id, feed, coalesce(line, '') as line from raw_flight_lines)),
v as (select *, trim(fs[8], ' ') as dep, trim(fs[9], ' ') as delay, trim(fs[7], ' ') as late from l),
n as (select *, case when regexp_full_match(dep, '[0-9]+([.]0+)?') then try_cast(split_part(dep, '.', 1) as bigint) end as dep_n,
 case when regexp_full_match(delay, '[0-9]+([.]0+)?') then try_cast(split_part(delay, '.', 1) as bigint) end as delay_n from v),
r as (select *, case when not sound then ['quoting'] when len(fs) <> 11 then ['columns'] else list_filter([
 case when feed = 'on_time' and dep not in ('', 'NA') and not coalesce(dep_n between 0 and 2400 and dep_n % 100 < 60, false) then 'DepTime' end,
 case when feed = 'on_time' and delay not in ('', 'NA') and not coalesce(delay_n between 0 and 2880, false) then 'DepDelayMinutes' end,
 case when feed = 'allyears' and upper(late) not in ('YES', 'NO') then 'IsDepDelayed' end], lambda x: x is not null) end as reasons from n)"""
SQL["p1_found"] = f"{_SQL_LINES} select line_id, unnest(reasons) as reason from r"


def _sql_typed(i: int, c: str) -> str:
    v = f"trim(fs[{i}], ' ')"
    if c in ("CRSDepTime", "DepTime", "DepDelayMinutes", "DepDel15"):
        return f"case when regexp_full_match({v}, '[0-9]+([.]0+)?') then try_cast(split_part({v}, '.', 1) as int) end as {c}"
    return f"try_cast(case when {v} not in ('', 'NA') then {v} end as {'date' if c == 'FlightDate' else 'varchar'}) as {c}"


SQL["p1_on_time"] = f"{_SQL_LINES} select line_id, " + ", ".join(_sql_typed(i, c) for i, c in enumerate(ON_TIME_FIELDS, 1)) + " from r where feed = 'on_time' and len(reasons) = 0"
SQL["p1_all_years"] = f"{_SQL_LINES} select line_id, " + ", ".join(f"nullif(fs[{i}], '') as {c}" for i, c in enumerate(ALL_YEARS_FIELDS, 1)) + " from r where feed = 'allyears' and len(reasons) = 0"

#: Dates with slashes are month first, dotted ones day first.
CONVENTIONS = Conventions(("iso", "compact", "slash_mdy", "dot_dmy", "day_name", "name_day"))


def p2_moments(spark: SparkSession, d: str) -> DataFrame:
    """Every scheduled and actual departure of departure_stamps, each carrier's messages being one sequence."""
    zones = table(spark, d, "airports").groupBy(code("airport_code").alias("__code")).agg(F.min("tz_name").alias("__tz"))
    stamps = table(spark, d, "departure_stamps")
    placed = stamps.join(zones, code("Origin") == F.col("__code"), "left")
    return normalise(placed, "stamp_id", F.col("UniqueCarrier"), "FlightDate", ("CRSDepTime", "DepTime"), "__tz", CONVENTIONS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    named = p2_moments(spark, d).where("status is not null")
    return named.select("stamp_id", "field", F.when(F.col("status") == "ok", F.col("moment")).otherwise(F.col("status")).alias("moment"))


def p2_statuses(spark: SparkSession, d: str) -> DataFrame:
    """How many interpretations every value has, and what became of it; null where it names no time."""
    return p2_moments(spark, d).select("stamp_id", "field", "n_interpretations", "status")


def p2_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Dates of orders written day first by some sources and month first by others, read without conventions: only the order of each source's records tells."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    text = F.date_format("day", "dd/MM/yyyy")
    month_first = F.date_format("day", "MM/dd/yyyy")
    written = orders.select(
        (F.unix_date("day").cast("bigint") * 10**12 + F.col("o_orderkey")).alias("at"), F.col("o_orderpriority").alias("source"),
        F.concat(F.when(F.col("source") < "3", month_first).otherwise(text), F.lit(" 10:00")).alias("said"), F.lit(None).cast("string").alias("no_date"), F.lit("UTC").alias("zone"),
    )
    read = normalise(written, "at", F.col("source"), "no_date", ("said",), "zone", Conventions())
    return read.select((F.col("at") % 10**12).alias("o_orderkey"), F.substring("moment", 1, 10).alias("day"))


QUERIES |= {"p2_found": p2_found, "p2_moments": p2_moments, "p2_statuses": p2_statuses, "p2_ambiguous": p2_ambiguous}
SQL["p2_ambiguous"] = "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders"


_AREA = "[A-Za-z][A-Za-z0-9_+-]*(?:/[A-Za-z0-9_+-]+)+"
_ABBR = "|".join(sorted(ABBREVIATIONS, key=lambda x: (-len(x), x)))
_SQL_CLOCK = "([0-9]{1,2})[:h]([0-9]{2})(?::([0-9]{2})(?:[.]([0-9]+))?)?(?: ?([AaPp])[Mm])?"
_SQL_MONTH = f"coalesce(list_position({list(MONTHS)}, lower({{0}})), list_position({[m[:3] for m in MONTHS]}, lower({{0}})), 0)"
_SQL_DATES = (  # pattern, year, month and day
    ("([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", "m.a", "m.b", "m.c"), ("([0-9]{4})([0-9]{2})([0-9]{2})", "m.a", "m.b", "m.c"),
    ("([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})", "m.c", "m.a", "m.b"), ("([0-9]{1,2})[.]([0-9]{1,2})[.]([0-9]{4}|[0-9]{2})", "m.c", "m.b", "m.a"),
    ("(?:[A-Za-z]+, )?([0-9]{1,2})[ -]([A-Za-z]{3,9})[ -]([0-9]{4}|[0-9]{2})", "m.c", _SQL_MONTH.format("m.b"), "m.a"), ("(?:[A-Za-z]+, )?([A-Za-z]{3,9}) ([0-9]{1,2}),? ([0-9]{4})", "m.c", _SQL_MONTH.format("m.a"), "m.b"),
)


def _sql_date(pattern: str, year: str, month: str, day: str) -> str:
    m = f"regexp_extract(dt, '^{pattern}$', ['a', 'b', 'c'])"
    y, mo, d = (x.replace("m.", m + ".") for x in (year, month, day))
    return f"when regexp_full_match(dt, '{pattern}') then try_cast((case when length({y}) = 2 then '20' else '' end) || {y} || '-' || lpad(cast({mo} as varchar), 2, '0') || '-' || lpad({d}, 2, '0') as date)"


_WALL = "epoch_us(timezone(place, make_timestamptz({0})))"
_DAY = 86_400_000_000
_SQL_TIMES = f"""with z as (select upper(trim(airport_code, ' ')) as code, min(tz_name) as tz from airports group by 1),
s as (select stamp_id, field, trim(value, ' ') as v, trim(FlightDate, ' ') as fd, tz
 from (select stamp_id, Origin, FlightDate, unnest(['CRSDepTime', 'DepTime']) as field, unnest([CRSDepTime, DepTime]) as value from departure_stamps) left join z on upper(trim(Origin, ' ')) = code),
a as (select *, coalesce(nullif(regexp_extract(v, '\\[({_AREA})\\]$', 1), ''), nullif(regexp_extract(v, ' ({_AREA})$', 1), ''), '') as area,
 regexp_extract(v, '[0-9 Mm]([+-][0-9]{{2}}:?[0-9]{{2}})$', 1) as num, regexp_extract(v, '({_ABBR})$', 1) as abbr from s where v is not null),
b as (select *, case when area <> '' then regexp_replace(v, ' ?(\\[{_AREA}\\]|{_AREA})$', '') when num <> '' then regexp_replace(v, ' ?[+-][0-9]{{2}}:?[0-9]{{2}}$', '')
 when abbr <> '' then regexp_replace(v, ' ?({_ABBR})$', '') else v end as b, area = '' and num = '' and abbr = '' as bare,
 case when area <> '' then null when num <> '' then case when num[2:3]::int <= 18 and replace(num, ':', '')[4:5]::int < 60 then (num[2:3]::int * 3600 + replace(num, ':', '')[4:5]::int * 60) * (case when num[1] = '-' then -1 else 1 end) end
 when abbr <> '' then map({list(ABBREVIATIONS)}, {list(ABBREVIATIONS.values())})[abbr] end as off from a),
c as (select *, case when regexp_full_match(b, '[0-9]{{1,4}}') then {{'d': '', 'h': lpad(b, 4, '0')[1:2], 'm': lpad(b, 4, '0')[3:4], 's': '', 'f': '', 'half': ''}}
 when regexp_full_match(b, '[0-9]{{8}}T?[0-9]{{6}}') then {{'d': b[1:8], 'h': replace(b, 'T', '')[9:10], 'm': replace(b, 'T', '')[11:12], 's': replace(b, 'T', '')[13:14], 'f': '', 'half': ''}}
 when regexp_full_match(b, '(?:([^|]*?[^| T])(?:T| +))?{_SQL_CLOCK}') then regexp_extract(b, '^(?:([^|]*?[^| T])(?:T| +))?{_SQL_CLOCK}$', ['d', 'h', 'm', 's', 'f', 'half']) end as t,
 case when area <> '' then (select name from pg_timezone_names() n where n.name = area) when bare then tz end as place from b),
d as (select *, t.h::int as h, t.m::int as mi, coalesce(try_cast(t.s as int), 0) as sec, rpad(t.f[1:6], 6, '0')::int as us, lower(t.half) as half, case when t.d = '' then fd else t.d end as dt from c where t is not null),
e as (select *, case {" ".join(_sql_date(*x) for x in _SQL_DATES)} end as day,
 case when mi < 60 and sec < 60 and (case when half = '' then h < 24 or h = 24 and mi = 0 and sec = 0 and us = 0 else h between 1 and 12 end)
 then ((case when half = '' then h else h % 12 + (case when half = 'p' then 12 else 0 end) end) * 3600 + mi * 60 + sec)::bigint * 1000000 + us end as clock from d),
l as (select *, epoch_us(day::timestamp) + clock as local from e where day is not null and clock is not null),
n as (select *, local - ({_WALL.format(f"local - {_DAY}")} - (local - {_DAY})) as ub, local - ({_WALL.format(f"local + {_DAY}")} - (local + {_DAY})) as ua from l where off is null and place is not null),
o as (select stamp_id, field, case when ub = ua then ub when {_WALL.format("ub")} = local and {_WALL.format("ua")} = local then -1 when {_WALL.format("ub")} = local then ub when {_WALL.format("ua")} = local then ua else -2 end as u from n
 union all select stamp_id, field, local - off::bigint * 1000000 from l where off is not null
 union all select stamp_id, field, rpad(b, 16, '0')::bigint from b where bare and regexp_full_match(b, '[0-9]{{10}}|[0-9]{{13}}|[0-9]{{16}}'))
"""
SQL["p2_found"] = f"{_SQL_TIMES} select stamp_id, field, case u when -1 then 'overlap' when -2 then 'gap' else strftime(make_timestamp(u), '%Y-%m-%dT%H:%M:%S.%fZ') end as moment from o"
SQL["p2_statuses"] = f"""{_SQL_TIMES} select d.stamp_id, d.field, cast(case when u is null then 0 when u = -1 then 2 else 1 end as int) as n_interpretations,
 case when u is null then null when u = -1 then 'overlap' when u = -2 then 'gap' else 'ok' end as status
from (select stamp_id, unnest(['CRSDepTime', 'DepTime']) as field from departure_stamps) d left join o on o.stamp_id = d.stamp_id and o.field = d.field"""


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    """All of the trailing periods' columns for DepDel15."""
    return rolling(table(spark, d, ON_TIME), code("Origin"), F.col("FlightDate"), F.col("DepDel15"), FIRST_DAY, LAST_DAY, (7, 30), "origin")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_rolling(spark, d).select("origin", F.date_format("day", "yyyy-MM-dd").alias("flight_day"), "total_7d", "total_30d")


QUERIES |= {"p3_found": p3_found, "p3_rolling": p3_rolling}
_SQL_DAYS = f"""with f as (select upper(trim(Origin, ' ')) as origin, FlightDate as d, sum(DepDel15) as s, count(DepDel15) as c, min(DepDel15) as lo, max(DepDel15) as hi
 from {ON_TIME} where Origin is not null and FlightDate is not null group by all),
grid as (select origin, cast(g.d as date) as d from (select distinct origin from f), (select unnest(generate_series(date '2015-01-01', date '2015-03-31', interval 1 day)) as d) g)"""
SQL["p3_found"] = f"""{_SQL_DAYS}
select g.origin, strftime(g.d, '%Y-%m-%d') as flight_day, cast(coalesce(sum(s) filter (f.d > g.d - 7), 0) as bigint) as total_7d, cast(coalesce(sum(s), 0) as bigint) as total_30d
from grid g left join f on f.origin = g.origin and f.d <= g.d and f.d > g.d - 30 group by all"""
SQL["p3_rolling"] = f"""{_SQL_DAYS}
select g.origin, g.d as day, """ + ", ".join(
    f"""cast(coalesce(sum(s) filter (f.d > g.d - {p}), 0) as bigint) as total_{p}d, cast(coalesce(sum(c) filter (f.d > g.d - {p}), 0) as bigint) as n_{p}d,
cast(sum(s) filter (f.d > g.d - {p}) as double) / nullif(sum(c) filter (f.d > g.d - {p}), 0) as mean_{p}d,
cast(min(lo) filter (f.d > g.d - {p}) as bigint) as least_{p}d, cast(max(hi) filter (f.d > g.d - {p}) as bigint) as most_{p}d"""
    for p in (7, 30)
) + " from grid g left join f on f.origin = g.origin and f.d <= g.d and f.d > g.d - 30 group by all"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The codes with a twentieth of their table's rows or more."""
    parts = [
        heavy_keys(table(spark, d, name), code(field), Fraction(1, 20), "code").select(F.lit(field).alias("field"), "code")
        for name, field in ((ON_TIME, "Origin"), (ALL_YEARS, "Dest"))
    ]
    return parts[0].unionByName(parts[1])


def p5_per_origin(spark: SparkSession, d: str) -> DataFrame:
    """Counts and delays of every Origin code of the on-time table, null included."""
    return per_key(table(spark, d, ON_TIME), {"code": code("Origin")}, {"delay": F.col("DepDelayMinutes"), "late": F.col("DepDel15")})


def p5_per_dest(spark: SparkSession, d: str) -> DataFrame:
    """Counts and delayed flights of every Dest code of the all-years table."""
    said = F.upper(F.trim("IsDepDelayed"))
    late = F.when(said == "YES", 1).when(said == "NO", 0)
    return per_key(table(spark, d, ALL_YEARS), {"code": code("Dest")}, {"late": late})


QUERIES |= {"p5_found": p5_found, "p5_per_origin": p5_per_origin, "p5_per_dest": p5_per_dest}
SQL["p5_found"] = " union all ".join(
    f"select '{field}' as field, upper(trim({field}, ' ')) as code from {name} where {field} is not null group by all having count(*) * 20 >= (select count(*) from {name})"
    for name, field in ((ON_TIME, "Origin"), (ALL_YEARS, "Dest"))
)


def _sql_per_key(key: str, values: dict[str, str], name: str) -> str:
    parts = ", ".join(f"count({v}) as {n}_n, cast(sum({v}) as bigint) as {n}_sum, avg({v}) as {n}_mean, min({v}) as {n}_min, max({v}) as {n}_max" for n, v in values.items())
    return f"select upper(trim({key}, ' ')) as code, count(*) as n_rows, {parts} from {name} group by 1"


SQL["p5_per_origin"] = _sql_per_key("Origin", {"delay": "DepDelayMinutes", "late": "DepDel15"}, ON_TIME)
SQL["p5_per_dest"] = _sql_per_key("Dest", {"late": "(case upper(trim(IsDepDelayed, ' ')) when 'YES' then 1 when 'NO' then 0 end)"}, ALL_YEARS)
