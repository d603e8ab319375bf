"""Queries of the operators for training data, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panewright.llm import abuse, mixing, tokens
from panewright.llm.quantiles import merge_summaries, percentiles, rank_error, summaries
from panewright.llm.topn import kept_layout, skipped, top_n
from panewright.sources import code, scratch_path, spread_table, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ON_TIME, ALL_YEARS = "on_time_on_time_performance_2015_3", "allyears2k_headers"


def number(name: str) -> Column:
    """Digits, maybe with a point and zeros, spaces around them aside, as a number; over 18 digits the largest; else null."""
    v = F.trim(F.col(name))
    digits = F.regexp_replace(F.regexp_replace(v, r"\.0+\z", ""), r"\A0+(?=.)", "")
    return F.when(v.rlike(r"\A[0-9]+(?:\.0+)?\z"), F.when(F.length(digits) > 18, F.lit(2**63 - 1)).otherwise(digits.try_cast("bigint")))


def _departures(spark: SparkSession, d: str) -> list[tuple]:
    """What is asked about the years and the quarter: name, rows, groups, score, N."""
    return [
        ("allyears", table(spark, d, ALL_YEARS), [code("Dest")], number("Deptime"), 10),
        ("on_time", table(spark, d, ON_TIME), [code("Dest"), F.col("FlightDate")], F.col("DepDelayMinutes"), 3),
    ]


#: Session setting: a folder that the layouts of problem 4 are kept in and read from again. Unset, each query writes its own.
LAYOUTS = "spark.panewright.topn.layouts"


def _layouts(spark: SparkSession, d: str) -> list[tuple[str, str, int]]:
    """Name, layout and N of what is asked."""
    folder = spark.conf.get(LAYOUTS, None)
    at = lambda name: f"{folder.rstrip('/')}/{name}" if folder else scratch_path(spark, "topn")
    return [(name, kept_layout(df, groups, score, F.col("row_id"), at(name)), n) for name, df, groups, score, n in _departures(spark, d)]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The 10 latest departures per destination over the years, the 3 most delayed per destination and day of the quarter."""
    parts = [top_n(spark, path, n).select(F.lit(name).alias("table_name"), F.col("i").alias("row_id")) for name, path, n in _layouts(spark, d)]
    return parts[0].unionByName(parts[1])


def p4_skipped(spark: SparkSession, d: str) -> DataFrame:
    """How many row groups of the two layouts exist, aren't planned, are skipped and read for p4_found."""
    parts = [skipped(spark, path, n).select(F.lit(name).alias("table_name"), "*") for name, path, n in _layouts(spark, d)]
    return parts[0].unionByName(parts[1])


QUERIES |= {"p4_found": p4_found, "p4_skipped": p4_skipped}
SQL["p4_found"] = f"""select 'allyears' as table_name, row_id from (select *, row_number() over (partition by dest order by n desc, row_id) as r
 from (select row_id, upper(trim(Dest, ' ')) as dest, case when regexp_full_match(trim(Deptime, ' '), '[0-9]+([.]0+)?') then cast(split_part(trim(Deptime, ' '), '.', 1) as bigint) end as n from {ALL_YEARS}) where n is not null) where r <= 10
union all select 'on_time', row_id from (select row_id, row_number() over (partition by upper(trim(Dest, ' ')), FlightDate order by DepDelayMinutes desc, row_id) as r from {ON_TIME} where DepDelayMinutes is not null) where r <= 3"""


#: The percentiles asked for.
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
_CODES = ["field", "code"]


def p6_daily(spark: SparkSession, d: str) -> DataFrame:
    """A summary of DepDelayMinutes for each day of each UniqueCarrier and each Origin: `field`, `code`, `day`, `n`, `sketch`."""
    each = {"UniqueCarrier": F.col("UniqueCarrier"), "Origin": code("Origin")}
    return summaries(table(spark, d, ON_TIME), {"day": F.col("FlightDate").cast("string")}, F.col("DepDelayMinutes"), each=each)


def p6_days(spark: SparkSession, d: str) -> DataFrame:
    """How many values each day's summary stands for."""
    return p6_daily(spark, d).select("field", "code", "day", "n")


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The percentiles of each UniqueCarrier and Origin over all days, out of the daily summaries; null is a group."""
    found = percentiles(merge_summaries(p6_daily(spark, d), _CODES), _CODES, PERCENTILES)
    return found.withColumns({f"{q}_rank_error": F.lit(rank_error(v)) for q, v in PERCENTILES.items()})


def p6_within(spark: SparkSession, d: str) -> DataFrame:
    """For each group whether every percentile's true rank is within the stated error, judged over all rows."""
    base = table(spark, d, ON_TIME).where("DepDelayMinutes is not null")
    found = p6_percentiles(spark, d)
    rows = None
    for name, value in (("UniqueCarrier", F.col("UniqueCarrier")), ("Origin", code("Origin"))):
        counts = base.groupBy(value.alias("code"), F.col("DepDelayMinutes").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("field", F.lit(name))
        rows = counts if rows is None else rows.unionByName(counts)
    joined = rows.join(found, rows["field"].eqNullSafe(found["field"]) & rows["code"].eqNullSafe(found["code"])).select(rows["field"], rows["code"], "v", "c", "n", *PERCENTILES)
    ranks = joined.groupBy("field", "code", "n").agg(
        *(F.sum(F.when(F.col("v") < F.col(q), F.col("c")).otherwise(0)).alias(f"{q}_below") for q in PERCENTILES),
        *(F.sum(F.when(F.col("v") <= F.col(q), F.col("c")).otherwise(0)).alias(f"{q}_upto") for q in PERCENTILES), F.sum("c").alias("c"),
    )
    ok = [(F.col(f"{q}_below") <= (v + rank_error(v)) * F.col("n") + 1) & (F.col(f"{q}_upto") >= (v - rank_error(v)) * F.col("n") - 1) for q, v in PERCENTILES.items()]
    every = ok[0]
    for x in ok[1:]:
        every = every & x
    return ranks.select("field", "code", "n", (every & (F.col("n") == F.col("c"))).alias("within"))


QUERIES |= {"p6_percentiles": p6_percentiles, "p6_daily": p6_daily, "p6_days": p6_days, "p6_within": p6_within}
_SQL_FIELDS = f"(select unnest(['UniqueCarrier', 'Origin']) as field, unnest([UniqueCarrier, upper(trim(Origin, ' '))]) as code, FlightDate, DepDelayMinutes from {ON_TIME})"
SQL["p6_days"] = f"select field, code, cast(FlightDate as varchar) as day, count(*) as n from {_SQL_FIELDS} where DepDelayMinutes is not null group by all"
SQL["p6_within"] = f"""select 'UniqueCarrier' as field, UniqueCarrier as code, count(*) as n, true as "within" from {ON_TIME} where DepDelayMinutes is not null group by UniqueCarrier
union all select 'Origin', upper(trim(Origin, ' ')), count(*), true from {ON_TIME} where DepDelayMinutes is not null group by upper(trim(Origin, ' '))"""


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(spread_table(spark, d, "documents", "doc_id", "text")).select("doc_id", "ids")


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Ids with the characters that each token covers."""
    return tokens.encode_with_offsets(spread_table(spark, d, "documents", "doc_id", "text")).drop("text")


def p7_covered(spark: SparkSession, d: str) -> DataFrame:
    """Of each document how many characters its tokens cover, and whether each goes on where the one before ended, but for characters split over tokens."""
    found = p7_offsets(spark, d)
    steps = F.zip_with(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda s, e: (s == e) | (s == e - 1))
    chained = F.when(F.size("starts") < 2, F.lit(True)).otherwise(F.forall(steps, lambda x: x))
    first = F.coalesce(F.get("starts", F.lit(0)), F.lit(0)) == 0
    return found.select("doc_id", F.coalesce(F.array_max("ends"), F.lit(0)).cast("bigint").alias("n_covered"), (chained & first).alias("chained"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids; null comes back empty."""
    return tokens.decoded(tokens.encode(spread_table(spark, d, "documents", "doc_id", "text")), text="text_again").select("doc_id", "text_again")


QUERIES |= {"p7_ids": p7_ids, "p7_offsets": p7_offsets, "p7_covered": p7_covered, "p7_round_trip": p7_round_trip}
SQL["p7_covered"] = "select doc_id, n_chars as n_covered, true as chained from documents"
SQL["p7_round_trip"] = "select doc_id, coalesce(text, '') as text_again from documents"


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixing.Plan]]:
    targets = table(spark, d, "mix_targets")
    sizes = mixing.sized(spread_table(spark, d, "documents", "doc_id", "source", "text"), targets, tokens.count_tokens)
    planned = mixing.plans(sizes, targets)
    return mixing.mix(sizes, planned), planned


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, sources that fall short or have no documents included."""
    return mixing.shares(*_mixed(spark, d))


def p8_within(spark: SparkSession, d: str) -> DataFrame:
    """For each target whether its share is met within the stated tolerance, or used up where it can't be, and no document is used too often."""
    every = F.col("max_repeats") * F.col("available_tokens") == F.col("reached_tokens")
    ok = F.when(F.col("status") == "short", every).otherwise(F.col("status").isin("met", "no_documents"))
    return p8_shares(spark, d).select("source", (ok & (F.col("most_copies") <= F.col("max_repeats"))).alias("within"))


def p8_used(spark: SparkSession, d: str) -> DataFrame:
    """Whether every document of the mixture is one of its source's, used at most as often as allowed, once in the list: a row per source."""
    mixture, planned = _mixed(spark, d)
    known = table(spark, d, "documents").select("doc_id", F.col("source").alias("__s"))
    most = table(spark, d, "mix_targets").select(F.col("source").alias("__t"), "max_repeats")
    joined = mixture.join(known, "doc_id", "left").join(F.broadcast(most), F.col("source") == F.col("__t"), "left")
    ok = F.coalesce((F.col("__s") == F.col("source")) & F.col("copies").between(1, F.col("max_repeats")), F.lit(False))
    by = joined.groupBy("source").agg(F.bool_and(ok).alias("ok"), F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("m"))
    return by.select("source", (F.col("ok") & (F.col("n") == F.col("m"))).alias("sound"))


#: Session setting: a folder that the classifier is read from, or trained and written to if it isn't there. Unset, each query trains its own.
MODEL = "spark.panewright.abuse.model"


def _model(spark: SparkSession, d: str) -> abuse.Model:
    path = spark.conf.get(MODEL, None)
    if path:
        try:
            return abuse.load(spark, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    model = abuse.train(table(spark, d, "documents"), table(spark, d, "review_labels"))
    if path:
        abuse.save(spark, model, path)
    return model


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(spread_table(spark, d, "documents", "doc_id", "source", "text"), _model(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("score > 0").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document's score."""
    return _scored(spark, d).withColumn("found", F.col("score") > 0)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Cases per source; null is a source of its own."""
    by = _scored(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("score") > 0).alias("n_found"), F.avg("score").alias("mean_score"))
    return by.withColumn("rate", F.col("n_found") / F.col("n_documents"))


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of each source the documents, and those that have a score."""
    return _scored(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count("score").alias("n_scored"))


QUERIES |= {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_within": p8_within, "p8_used": p8_used, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates, "p9_counts": p9_counts}
SQL["p8_within"] = "select source, true as within from mix_targets"
SQL["p8_used"] = "select distinct source, true as sound from documents where source in (select source from mix_targets) and length(text) > 0"
SQL["p9_counts"] = "select source, count(*) as n_documents, count(*) as n_scored from documents group by source"
