"""Per-key results where a few keys hold most rows.

Only aggregates whose states merge are used, so that each task reduces its rows to one state per key before anything is shuffled:
a hot key costs one state per map task, whatever its rows. Spark's hash aggregate spills its states once its memory is full.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, keys: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """One row per key: `n_rows`, and of each value `<name>_n` (non-null), `_sum`, `_mean`, `_min` and `_max`.

    A null key is a group of its own. Where a key has no value, its `_n` is 0 and the rest null. An empty table gives no row. Rows that repeat
    all count. Other columns, whatever their names, are left out before the aggregation.
    """
    held = df.select(*(c.alias(f"__k{i}") for i, c in enumerate(keys.values())), *(c.alias(f"__v{i}") for i, c in enumerate(values.values())))
    out: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    for i, name in enumerate(values):
        v = F.col(f"__v{i}")
        out += [F.count(v).alias(f"{name}_n"), F.sum(v).alias(f"{name}_sum"), F.avg(v).alias(f"{name}_mean"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max")]
    by = held.groupBy(*(F.col(f"__k{i}").alias(k) for i, k in enumerate(keys))).agg(*out)
    return by


def heavy_keys(df: DataFrame, key: Column, share: Fraction, name: str = "key") -> DataFrame:
    """The keys, null aside, with at least `share` of all rows (null keys' rows included): columns `name` and `n_rows`.

    At most 1 / share rows. The total is a count that reads no column, compared as a scalar, so no key's rows meet in one task.
    """
    by = per_key(df, {name: key}, {})
    total = df.agg(F.count(F.lit(1)).alias("t"))
    enough = F.col("n_rows") * share.denominator >= total.scalar() * share.numerator
    return by.where(F.col(name).isNotNull() & enough).select(name, "n_rows")
