"""Queries of the window engine over orders, events, supplier and the two flight tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panewright import functions as P
from panewright.plans.expr import Node
from panewright.plans.rewrite import Rewrites
from panewright.plans.window import WindowDef, asc, desc, window
from panewright.operators.spread_windows import spread
from panewright.sources import code, header_csv, scratch_path, table
from panewright.streaming import running

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Every ROWS order below ends in a unique key.
UNIQUE = Rewrites(unique_order=True)
ORDERED = window().partition_by("o_custkey").order_by("o_orderdate", "o_orderkey")


def day() -> Column:
    return F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))


def not_p() -> Column:
    return F.nullif(F.col("o_orderstatus"), F.lit("P"))



BY_DAY = window().partition_by("o_orderpriority").order_by(asc(day))

SQL_DAY = "datediff('day', timestamp '1992-01-01', o_orderdate)"
SQL_O = "partition by o_custkey order by o_orderdate asc nulls first, o_orderkey asc nulls first"
SQL_P = f"partition by o_orderpriority order by {SQL_DAY} asc nulls first"


def money(name: str = "o_totalprice") -> Column:
    return F.col(name).cast("decimal(18,2)")


def total() -> P.Aggregate:
    return P.sum_(money, "decimal(28,2)")


def orders(key: str, columns: dict[str, Node], sql: dict[str, str], use: Rewrites = UNIQUE) -> None:
    """Registers a query that adds `columns` to o_orderkey."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "orders").select("o_orderkey", *(e.col(use).alias(n) for n, e in columns.items()))

    QUERIES[key] = run
    SQL[key] = "select o_orderkey, " + ", ".join(f"{e} as {n}" for n, e in sql.items()) + " from orders"


def summed(key: str, w: WindowDef, over: str) -> None:
    orders(key, {"total": total().over(w).cast("double")}, {"total": f"cast(sum(cast(o_totalprice as decimal(18,2))) over ({over}) as double)"})


summed("rows_global", ORDERED, f"{SQL_O} rows between unbounded preceding and unbounded following")
summed("rows_running", ORDERED.running(), f"{SQL_O} rows between unbounded preceding and current row")
summed("rows_up_2p", ORDERED.unbounded_preceding().rows_following(-2), f"{SQL_O} rows between unbounded preceding and 2 preceding")
summed("rows_up_1f", ORDERED.rows_following(1), f"{SQL_O} rows between unbounded preceding and 1 following")
summed("rows_sliding", ORDERED.rows_preceding(1).rows_following(1), f"{SQL_O} rows between 1 preceding and 1 following")
summed("rows_trailing", ORDERED.rows_preceding(3).rows_following(-1), f"{SQL_O} rows between 3 preceding and 1 preceding")
summed("rows_leading", ORDERED.rows_preceding(-1).rows_following(3), f"{SQL_O} rows between 1 following and 3 following")
summed("rows_wide", ORDERED.rows_preceding(60).rows_following(-5), f"{SQL_O} rows between 60 preceding and 5 preceding")
summed("rows_single", ORDERED.shifted(2), f"{SQL_O} rows between 2 following and 2 following")
summed("rows_cr_uf", ORDERED.rows_preceding(0), f"{SQL_O} rows between current row and unbounded following")
summed("rows_2f_uf", ORDERED.rows_preceding(-2), f"{SQL_O} rows between 2 following and unbounded following")
summed("rows_1p_uf", ORDERED.rows_preceding(1), f"{SQL_O} rows between 1 preceding and unbounded following")
summed("range_sym", BY_DAY.values_preceding(30).values_following(30), f"{SQL_P} range between 30 preceding and 30 following")
summed("range_up_cr", BY_DAY.values_following(0), f"{SQL_P} range between unbounded preceding and current row")
summed("range_up_7f", BY_DAY.values_following(7), f"{SQL_P} range between unbounded preceding and 7 following")
summed("range_cr_uf", BY_DAY.values_preceding(0), f"{SQL_P} range between current row and unbounded following")
summed("range_7p_uf", BY_DAY.values_preceding(7), f"{SQL_P} range between 7 preceding and unbounded following")
summed("range_before", BY_DAY.values_preceding(10).values_following(-1), f"{SQL_P} range between 10 preceding and 1 preceding")
summed("range_after", BY_DAY.values_preceding(-1).values_following(10), f"{SQL_P} range between 1 following and 10 following")
summed("range_peers", BY_DAY.values_preceding(0).values_following(0), f"{SQL_P} range between current row and current row")
summed(
    "range_desc", window().partition_by("o_orderpriority").order_by(desc(day)).values_preceding(30).values_following(0),
    f"partition by o_orderpriority order by {SQL_DAY} desc nulls last range between 30 preceding and current row",
)

PRIORITY = window().partition_by("o_orderpriority").order_by("o_orderdate")
SQL_PRIORITY = "partition by o_orderpriority order by o_orderdate nulls first"
orders("row_number", {"n": P.row_number().over(ORDERED)}, {"n": f"cast(row_number() over ({SQL_O}) as bigint)"})
orders("rank", {"r": P.rank().over(PRIORITY)}, {"r": f"cast(rank() over ({SQL_PRIORITY}) as bigint)"})
orders("dense_rank", {"r": P.dense_rank().over(PRIORITY)}, {"r": f"cast(dense_rank() over ({SQL_PRIORITY}) as bigint)"})
orders("lead1", {"v": P.lead("o_totalprice").over(ORDERED)}, {"v": f"lead(o_totalprice, 1) over ({SQL_O})"})
orders("lag3", {"v": P.lag("o_totalprice", 3).over(ORDERED)}, {"v": f"lag(o_totalprice, 3) over ({SQL_O})"})
orders("lead_expr", {"v": P.lead(P.col("o_totalprice") * 2).over(ORDERED)}, {"v": f"lead(o_totalprice * 2, 1) over ({SQL_O})"})
orders("shift0", {"v": P.shift("o_totalprice", 0).over(ORDERED)}, {"v": f"lead(o_totalprice, 0) over ({SQL_O})"})
orders(
    "share", {"share": P.col("o_totalprice") / total().over(window().partition_by("o_custkey")).cast("double")},
    {"share": "o_totalprice / cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey) as double)"},
)
AROUND = ORDERED.rows_preceding(2).rows_following(2)
SQL_AROUND = f"{SQL_O} rows between 2 preceding and 2 following"
orders(
    "minmaxavg",
    {"lo": P.min_("o_totalprice").over(AROUND), "hi": P.max_("o_totalprice").over(AROUND), "n": P.count().over(AROUND), "known": P.count(not_p).over(AROUND)},
    {"lo": f"min(o_totalprice) over ({SQL_AROUND})", "hi": f"max(o_totalprice) over ({SQL_AROUND})", "n": f"count(*) over ({SQL_AROUND})", "known": f"count(nullif(o_orderstatus, 'P')) over ({SQL_AROUND})"},
)
BEHIND = ORDERED.rows_preceding(2).rows_following(0)
SQL_BEHIND = f"{SQL_O} rows between 2 preceding and current row"
orders(
    "avg", {"v": P.sum_(money, "decimal(28,2)").over(BEHIND).cast("double") / P.count("o_totalprice").over(BEHIND)},
    {"v": f"cast(sum(cast(o_totalprice as decimal(18,2))) over ({SQL_BEHIND}) as double) / count(o_totalprice) over ({SQL_BEHIND})"},
)
orders(
    "first_last", {"f": P.first("o_totalprice").over(AROUND), "l": P.last("o_totalprice").over(AROUND)},
    {"f": f"first_value(o_totalprice) over ({SQL_AROUND})", "l": f"last_value(o_totalprice) over ({SQL_AROUND})"},
)
orders("first_rev", {"f": P.first("o_totalprice").over(ORDERED.rows_preceding(0))}, {"f": f"first_value(o_totalprice) over ({SQL_O} rows between current row and unbounded following)"})
orders("min_rev", {"lo": P.min_("o_totalprice").over(ORDERED.rows_preceding(-1))}, {"lo": f"min(o_totalprice) over ({SQL_O} rows between 1 following and unbounded following)"})
orders(
    "distinct_frame", {"n": P.count_distinct("o_orderstatus").over(ORDERED.rows_preceding(4).rows_following(0))},
    {"n": f"count(distinct o_orderstatus) over ({SQL_O} rows between 4 preceding and current row)"},
)
STATUS = P.count_distinct("o_orderstatus")
orders(
    "distinct_following",
    {"after": STATUS.over(ORDERED.rows_preceding(-1)), "so_far": P.count_distinct("o_orderpriority").over(ORDERED.running()), "whole": STATUS.over(window().partition_by("o_custkey"))},
    {"after": f"count(distinct o_orderstatus) over ({SQL_O} rows between 1 following and unbounded following)", "so_far": f"count(distinct o_orderpriority) over ({SQL_O} rows between unbounded preceding and current row)",
     "whole": "count(distinct o_orderstatus) over (partition by o_custkey)"},
)
orders(
    "distinct_empty", {"n": STATUS.over(ORDERED.rows_preceding(-2).rows_following(1)), "m": P.count().over(ORDERED.rows_preceding(-2).rows_following(1)), "far": STATUS.over(ORDERED.rows_preceding(-900).rows_following(901))},
    {"n": "cast(0 as bigint)", "m": "cast(0 as bigint)", "far": "cast(0 as bigint)"}, Rewrites(unique_order=True, empty_as_null=True),
)
BIG = P.sum_(lambda: (F.col("o_orderkey") % 3 + 1) * F.lit(2**61), "bigint")
orders(
    "following_big", {"v": BIG.over(ORDERED.rows_preceding(-1).rows_following(1)), "w": P.coalesce(BIG.over(ORDERED.rows_preceding(-1).rows_following(1)), P.lit(0))},
    {"v": f"lead((o_orderkey % 3 + 1) * {2**61}) over ({SQL_O})", "w": f"coalesce(lead((o_orderkey % 3 + 1) * {2**61}) over ({SQL_O}), 0)"},
    Rewrites(shift=False, slide_from=1, unique_order=True),
)
orders(
    "following_desc", {"lo": P.min_("o_totalprice").over(window().partition_by("o_custkey").order_by(desc("o_orderdate"), desc("o_orderkey")).rows_preceding(0))},
    {"lo": "min(o_totalprice) over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey desc nulls last rows between current row and unbounded following)"},
)
orders(
    "over_builder", {"n": P.count().over(P.sum_("o_totalprice").over(ORDERED.running())), "m": P.count().over()},
    {"n": f"count(*) over ({SQL_O} rows between unbounded preceding and current row)", "m": "count(*) over ()"},
)
orders(
    "unbounded_following", {"n": P.count().over(ORDERED.rows_preceding(2).rows_following(1).unbounded_following()), "m": P.count().over(ORDERED.running().unbounded_following())},
    {"n": f"count(*) over ({SQL_O} rows between 2 preceding and unbounded following)", "m": "count(*) over (partition by o_custkey)"},
)
orders(
    "mixed_kinds", {"n": P.count().over(BY_DAY.rows_preceding(3).values_following(7))},
    {"n": f"count(*) over ({SQL_P} range between 3 preceding and 7 following)"},
)
orders(
    "no_rewrites", {"after": total().over(ORDERED.rows_preceding(0)).cast("double"), "wide": total().over(ORDERED.rows_preceding(60).rows_following(-5)).cast("double"), "next": P.max_("o_totalprice").over(ORDERED.shifted(1))},
    {"after": f"cast(sum(cast(o_totalprice as decimal(18,2))) over ({SQL_O} rows between current row and unbounded following) as double)",
     "wide": f"cast(sum(cast(o_totalprice as decimal(18,2))) over ({SQL_O} rows between 60 preceding and 5 preceding) as double)", "next": f"lead(o_totalprice) over ({SQL_O})"},
    Rewrites.none(),
)
NTH = P.row_number().over(ORDERED)
orders(
    "operators", {"later": ~(NTH == 1), "back": -NTH, "known": P.lag("o_orderkey").over(ORDERED).is_not_null(), "some": NTH.isin(1, 3), "middle": NTH.between(2, P.count().over(window().partition_by("o_custkey")) - 1)},
    {"later": f"row_number() over ({SQL_O}) <> 1", "back": f"cast(-(row_number() over ({SQL_O})) as bigint)", "known": f"lag(o_orderkey) over ({SQL_O}) is not null",
     "some": f"row_number() over ({SQL_O}) in (1, 3)", "middle": f"row_number() over ({SQL_O}) between 2 and count(*) over (partition by o_custkey) - 1"},
)
orders(
    "dist_ranks", {"pr": P.percent_rank().over(ORDERED), "cd": P.cume_dist().over(ORDERED), "quarter": P.ntile(4).over(ORDERED)},
    {"pr": f"percent_rank() over ({SQL_O})", "cd": f"cume_dist() over ({SQL_O})", "quarter": f"cast(ntile(4) over ({SQL_O}) as bigint)"},
)
orders(
    "percentile", {"median": P.percentile("o_totalprice", 0.5).over(window().partition_by("o_custkey"))},
    {"median": "quantile_cont(o_totalprice, 0.5) over (partition by o_custkey)"},
)
orders(
    "stddev", {"sd": P.Composite(lambda c: F.round(c, 4), (P.stddev("o_totalprice").over(window().partition_by("o_custkey")),))},
    {"sd": "round(stddev_samp(o_totalprice) over (partition by o_custkey), 4)"},
)
orders(
    "null_keys",
    {"n": P.count().over(window().partition_by(not_p).order_by(asc(lambda: F.nullif(F.dayofmonth("o_orderdate"), F.lit(5)))).values_following(0))},
    {"n": "count(*) over (partition by nullif(o_orderstatus, 'P') order by nullif(day(o_orderdate), 5) nulls first range between unbounded preceding and current row)"},
)
orders(
    "composite_over",
    {"share": (total().cast("double") / (P.count("o_orderkey") + P.lit(1))).over(ORDERED.running())},
    {"share": f"cast(sum(cast(o_totalprice as decimal(18,2))) over ({SQL_O} rows between unbounded preceding and current row) as double) / (count(o_orderkey) over ({SQL_O} rows between unbounded preceding and current row) + 1)"},
)
BY_KEY = "partition by o_orderpriority order by o_orderkey asc nulls first"
KEYED = window().partition_by("o_orderpriority").order_by("o_orderkey")
orders(
    "multi_frame",
    {"whole": total().over(KEYED).cast("double"), "running": total().over(KEYED.running()).cast("double"), "around": P.max_("o_totalprice").over(KEYED.rows_preceding(2).rows_following(2)),
     "near": P.count().over(KEYED.values_preceding(50).values_following(50)), "after": P.lead("o_totalprice", 2).over(KEYED), "n": P.row_number().over(KEYED)},
    {"whole": "cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_orderpriority) as double)",
     "running": f"cast(sum(cast(o_totalprice as decimal(18,2))) over ({BY_KEY} rows between unbounded preceding and current row) as double)",
     "around": f"max(o_totalprice) over ({BY_KEY} rows between 2 preceding and 2 following)", "near": f"count(*) over ({BY_KEY} range between 50 preceding and 50 following)",
     "after": f"lead(o_totalprice, 2) over ({BY_KEY})", "n": f"cast(row_number() over ({BY_KEY}) as bigint)"},
)


def layered(spark: SparkSession, d: str) -> DataFrame:
    """A shift of a windowed sum: Spark stages the two windows. The keys are stated once and reach the inner window too."""
    return table(spark, d, "orders").select("o_orderkey", P.lag(total().running().cast("double")).over(ORDERED).col(UNIQUE).alias("before"))


QUERIES["layered"] = layered
SQL["layered"] = f"select o_orderkey, lag(s) over ({SQL_O}) as before from (select *, cast(sum(cast(o_totalprice as decimal(18,2))) over ({SQL_O} rows between unbounded preceding and current row) as double) as s from orders)"


def filter_part(spark: SparkSession, d: str) -> DataFrame:
    """The partition key's filter reaches the scan; the rank's becomes a limit per group."""
    ranked = table(spark, d, "orders").select("o_custkey", "o_orderkey", P.row_number().over(ORDERED).col().alias("r"))
    return ranked.where("o_custkey < 100 and r <= 2")


QUERIES["filter_part"] = filter_part
SQL["filter_part"] = f"select * from (select o_custkey, o_orderkey, cast(row_number() over ({SQL_O}) as bigint) as r from orders) where o_custkey < 100 and r <= 2"


def following_directed(spark: SparkSession, d: str) -> DataFrame:
    """Columns with their own direction are reversed like others: no frame that Spark runs in quadratic time is left."""
    w = window().partition_by("o_custkey").order_by(F.desc("o_orderdate"), F.col("o_orderkey").desc_nulls_first()).rows_preceding(-1)
    return table(spark, d, "orders").select("o_orderkey", P.max_("o_totalprice").over(w).col(UNIQUE).alias("most"), P.last("o_orderkey").over(w).col(UNIQUE).alias("end"))


QUERIES["following_directed"] = following_directed
_DIRECTED = "partition by o_custkey order by o_orderdate desc nulls last, o_orderkey desc nulls first rows between 1 following and unbounded following"
SQL["following_directed"] = f"select o_orderkey, max(o_totalprice) over ({_DIRECTED}) as most, last_value(o_orderkey) over ({_DIRECTED}) as end from orders"


def csv_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows over a header CSV, read as strings and cast; the file is written from a table first."""
    path = scratch_path(spark, "csv")
    table(spark, d, "nation").coalesce(1).write.option("header", True).csv(path)
    w = window().partition_by("n_regionkey").order_by("n_nationkey")
    rows = header_csv(spark, path, {"n_nationkey": "int", "n_regionkey": "int"})
    return rows.select("n_name", "n_nationkey", P.count().over(w.running()).col(UNIQUE).alias("n"), P.lag("n_name").over(w).col().alias("before"))


QUERIES["csv_window"] = csv_window
SQL["csv_window"] = "select n_name, cast(n_nationkey as int) as n_nationkey, count(*) over (w rows between unbounded preceding and current row) as n, lag(n_name) over w as before from nation window w as (partition by n_regionkey order by n_nationkey nulls first)"


def agg_then_window(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.sum(money()).cast("double").alias("s"))
    return by.select("*", P.rank().over(window().partition_by("o_orderpriority").order_by(desc("s"), "o_orderstatus")).col().alias("r"))


QUERIES["agg_then_window"] = agg_then_window
SQL["agg_then_window"] = """select *, cast(rank() over (partition by o_orderpriority order by s desc nulls last, o_orderstatus nulls first) as bigint) as r
from (select o_orderpriority, o_orderstatus, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as s from orders group by all)"""


def no_partition(spark: SparkSession, d: str) -> DataFrame:
    w = window().order_by(desc("s_acctbal"), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", P.row_number().over(w).col().alias("n"))


def no_partition_spread(spark: SparkSession, d: str) -> DataFrame:
    """The same over all tasks: the table is sorted by ranges and windowed in blocks."""
    w = window().order_by(desc("s_acctbal"), "s_suppkey")
    return spread(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), w, {"n": P.row_number()}).select("s_suppkey", "n")


QUERIES |= {"no_partition": no_partition, "no_partition_spread": no_partition_spread}
SQL["no_partition"] = SQL["no_partition_spread"] = "select s_suppkey, cast(row_number() over (order by s_acctbal desc nulls last, s_suppkey nulls first) as bigint) as n from supplier"


def udaf_window(spark: SparkSession, d: str) -> DataFrame:
    """A grouped-aggregate Pandas UDF over a sliding frame."""

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min()) if len(v) else float("nan")

    return table(spark, d, "orders").select("o_orderkey", P.agg(spread, "o_totalprice").over(BEHIND).col().alias("spread"))


QUERIES["udaf_window"] = udaf_window
SQL["udaf_window"] = f"select o_orderkey, max(o_totalprice) over ({SQL_BEHIND}) - min(o_totalprice) over ({SQL_BEHIND}) as spread from orders"


def sql_text(spark: SparkSession, d: str) -> DataFrame:
    """Window functions in SQL text, with a named window."""
    return spark.sql(
        "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS seen, lag(event_type) OVER w AS before FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
        events=table(spark, d, "events"),
    )


QUERIES["sql_text"] = sql_text
SQL["sql_text"] = """select event_id, count(*) over (partition by user_id order by ts nulls first, event_id nulls first rows between 3 preceding and 1 preceding) as seen,
lag(event_type) over (partition by user_id order by ts nulls first, event_id nulls first) as before from events"""


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers, running totals and the value before, computed by a stream over the events; its output is read back."""
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")  # a pattern may be a file or a folder
    cents = stream.select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    out = scratch_path(spark, "streamed")
    written = running(cents, ["user_id"], ["ts", "event_id"], "cents").writeStream.option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True)
    written.format("parquet").start(out).awaitTermination()
    return spark.read.parquet(out).select("event_id", "n", "total", "least", "most", "before")


QUERIES["streamed"] = streamed
SQL["streamed"] = """select event_id, cast(row_number() over w as bigint) as n, cast(sum(cents) over r as bigint) as total, min(cents) over r as least, max(cents) over r as most, lag(cents) over w as before
from (select *, cast(round(value * 100) as bigint) as cents from events)
window w as (partition by user_id order by ts nulls first, event_id nulls first), r as (partition by user_id order by ts nulls first, event_id nulls first rows between unbounded preceding and current row)"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Flights from one airport: the delays among the three flights before to the same place, and a sequence number."""
    w = window().partition_by("Dest").order_by("Year", "Month", "DayofMonth", "Deptime", "row_id")
    flights = table(spark, d, "allyears2k_headers").withColumns({"Origin": code("Origin"), "Dest": code("Dest")})
    late = F.when(F.col("IsDepDelayed") == "YES", 1).otherwise(0)
    return flights.where(F.col("Origin") == "SAN").select(
        "row_id", "Origin", "Dest", "UniqueCarrier", "FlightNum", "TailNum", late.alias("Delay"),
        P.coalesce(P.sum_(late, "bigint").over(w).rows_preceding(3).rows_following(-1), P.lit(0)).col(UNIQUE).cast("bigint").alias("Past3Delays"),
        P.row_number().over(w).col().alias("FlightSeqNr"),
    )


QUERIES["flagship"] = flagship
SQL["flagship"] = """with f as (select row_id, upper(trim(Origin, ' ')) as Origin, upper(trim(Dest, ' ')) as Dest, UniqueCarrier, FlightNum, TailNum,
 case when IsDepDelayed = 'YES' then 1 else 0 end as Delay, Year, Month, DayofMonth, Deptime from allyears2k_headers)
select row_id, Origin, Dest, UniqueCarrier, FlightNum, TailNum, Delay, cast(coalesce(sum(Delay) over (w rows between 3 preceding and 1 preceding), 0) as bigint) as Past3Delays,
 cast(row_number() over w as bigint) as FlightSeqNr from f where Origin = 'SAN'
window w as (partition by Dest order by Year nulls first, Month nulls first, DayofMonth nulls first, Deptime nulls first, row_id nulls first)"""

FLIGHTS = window().partition_by("Origin").order_by("FlightDate", "CRSDepTime", "row_id")
SQL_FLIGHTS = "partition by Origin order by FlightDate nulls first, CRSDepTime nulls first, row_id nulls first"


def on_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "on_time_on_time_performance_2015_3").withColumn("Origin", code("Origin"))


def flights_sliding(spark: SparkSession, d: str) -> DataFrame:
    """The first benchmark: a sliding sum, the partition's sum and a row number."""
    late = P.sum_("DepDel15", "bigint")
    return on_time(spark, d).select(
        "row_id", "Origin", "Dest", "UniqueCarrier", "FlightNum", "TailNum", "FlightDate", "CRSDepTime", "DepTime", "DepDelayMinutes",
        late.over(FLIGHTS).rows_preceding(3).rows_following(-1).col(UNIQUE).alias("Past3DepDel15"),
        late.over(FLIGHTS).col(UNIQUE).alias("TotalDepDelay15"), P.row_number().over(FLIGHTS).col().alias("OriginFlightSeqNr"),
    )


def flights_running(spark: SparkSession, d: str) -> DataFrame:
    """The second benchmark: two running sums."""
    return on_time(spark, d).select(
        "row_id", "Origin", "Dest", "UniqueCarrier", "FlightNum", "TailNum", "FlightDate", "CRSDepTime", "DepTime", "DepDelayMinutes",
        *(P.sum_(c, "bigint").over(FLIGHTS).unbounded_preceding().rows_following(0).col(UNIQUE).alias(f"Running{c}") for c in ("DepDel15", "DepDelayMinutes")),
    )


def flights_remaining(spark: SparkSession, d: str) -> DataFrame:
    """The case that Spark runs in quadratic time: frames that end at UNBOUNDED FOLLOWING, over large partitions."""
    return on_time(spark, d).select(
        "row_id", P.sum_("DepDelayMinutes", "bigint").over(FLIGHTS.rows_preceding(0)).col(UNIQUE).alias("remaining"),
        P.max_("DepDelayMinutes").over(FLIGHTS.rows_preceding(-1)).col(UNIQUE).alias("worst_after"),
    )


SQL_PAYLOAD = "row_id, Origin, Dest, UniqueCarrier, FlightNum, TailNum, FlightDate, CRSDepTime, DepTime, DepDelayMinutes"
SQL_ON_TIME = "(select * replace (upper(trim(Origin, ' ')) as Origin) from on_time_on_time_performance_2015_3)"
QUERIES |= {"flights_sliding": flights_sliding, "flights_running": flights_running, "flights_remaining": flights_remaining}
SQL["flights_sliding"] = f"""select {SQL_PAYLOAD}, cast(sum(DepDel15) over ({SQL_FLIGHTS} rows between 3 preceding and 1 preceding) as bigint) as Past3DepDel15,
cast(sum(DepDel15) over (partition by Origin) as bigint) as TotalDepDelay15, cast(row_number() over ({SQL_FLIGHTS}) as bigint) as OriginFlightSeqNr from {SQL_ON_TIME}"""
SQL["flights_running"] = f"""select {SQL_PAYLOAD}, cast(sum(DepDel15) over (w rows between unbounded preceding and current row) as bigint) as RunningDepDel15,
cast(sum(DepDelayMinutes) over (w rows between unbounded preceding and current row) as bigint) as RunningDepDelayMinutes from {SQL_ON_TIME} window w as ({SQL_FLIGHTS})"""
SQL["flights_remaining"] = f"""select row_id, cast(sum(DepDelayMinutes) over (w rows between current row and unbounded following) as bigint) as remaining,
max(DepDelayMinutes) over (w rows between 1 following and unbounded following) as worst_after from {SQL_ON_TIME} window w as ({SQL_FLIGHTS})"""


def flights_spread(spark: SparkSession, d: str) -> DataFrame:
    """Running, remaining and whole sums and a row number per airport, the airports with most flights cut into blocks."""
    late, minutes = P.sum_("DepDel15", "bigint"), P.sum_("DepDelayMinutes", "bigint")
    columns = {
        "running_late": late.over(FLIGHTS.running()), "remaining_minutes": minutes.over(FLIGHTS.rows_preceding(0)), "all_minutes": minutes.over(FLIGHTS),
        "worst_so_far": P.max_("DepDelayMinutes").over(FLIGHTS.running()), "n": P.row_number().over(FLIGHTS),
    }
    flights = on_time(spark, d).select("row_id", "Origin", "FlightDate", "CRSDepTime", "DepDel15", "DepDelayMinutes")
    return spread(flights, FLIGHTS, columns).select("row_id", *columns)


def flights_sliding_spread(spark: SparkSession, d: str) -> DataFrame:
    """The first benchmark, with a shift and an extreme, over airports that are cut into blocks."""
    late = P.sum_("DepDel15", "bigint")
    columns = {
        "Past3DepDel15": late.over(FLIGHTS).rows_preceding(3).rows_following(-1), "TotalDepDelay15": late.over(FLIGHTS), "OriginFlightSeqNr": P.row_number().over(FLIGHTS),
        "next_carrier": P.lead("UniqueCarrier").over(FLIGHTS), "worst_around": P.max_("DepDelayMinutes").over(FLIGHTS.rows_preceding(10).rows_following(10)),
    }
    flights = on_time(spark, d).select("row_id", "Origin", "UniqueCarrier", "FlightDate", "CRSDepTime", "DepDel15", "DepDelayMinutes")
    return spread(flights, FLIGHTS, columns).select("row_id", *columns)


def flights_ranked_spread(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of days and a running total over all flights, without partition keys: no task has the whole table."""
    by_day, by_row = window().order_by("FlightDate"), window().order_by("FlightDate", "row_id")
    flights = on_time(spark, d).select("row_id", "FlightDate", "DepDel15")
    ranked = spread(flights, by_day, {"r": P.rank(), "day_number": P.dense_rank()})
    columns = {"late_so_far": P.sum_("DepDel15", "bigint").over(by_row.running()), "late_of_1000": P.sum_("DepDel15", "bigint").over(by_row.rows_preceding(999).rows_following(0))}
    return spread(ranked, by_row, columns).select("row_id", "r", "day_number", *columns)


QUERIES |= {"flights_spread": flights_spread, "flights_sliding_spread": flights_sliding_spread, "flights_ranked_spread": flights_ranked_spread}
SQL["flights_sliding_spread"] = f"""select row_id, cast(sum(DepDel15) over (w rows between 3 preceding and 1 preceding) as bigint) as Past3DepDel15,
cast(sum(DepDel15) over (partition by Origin) as bigint) as TotalDepDelay15, cast(row_number() over w as bigint) as OriginFlightSeqNr, lead(UniqueCarrier) over w as next_carrier,
max(DepDelayMinutes) over (w rows between 10 preceding and 10 following) as worst_around from {SQL_ON_TIME} window w as ({SQL_FLIGHTS})"""
SQL["flights_ranked_spread"] = """select row_id, cast(rank() over (order by FlightDate nulls first) as bigint) as r, cast(dense_rank() over (order by FlightDate nulls first) as bigint) as day_number,
cast(sum(DepDel15) over (w rows between unbounded preceding and current row) as bigint) as late_so_far, cast(sum(DepDel15) over (w rows between 999 preceding and current row) as bigint) as late_of_1000
from on_time_on_time_performance_2015_3 window w as (order by FlightDate nulls first, row_id nulls first)"""
_RUN = "w rows between unbounded preceding and current row"
SQL["flights_spread"] = f"""select row_id, cast(sum(DepDel15) over ({_RUN}) as bigint) as running_late,
cast(sum(DepDelayMinutes) over (w rows between current row and unbounded following) as bigint) as remaining_minutes, cast(sum(DepDelayMinutes) over (partition by Origin) as bigint) as all_minutes,
max(DepDelayMinutes) over ({_RUN}) as worst_so_far, cast(row_number() over w as bigint) as n from {SQL_ON_TIME} window w as ({SQL_FLIGHTS})"""
