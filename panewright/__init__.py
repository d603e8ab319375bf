"""Window analytics and data preparation on PySpark DataFrames."""

from panewright.functions import (
    agg, avg, coalesce, col, count, count_distinct, cume_dist, dense_rank, first, lag, last, lead, lit, max_, min_, ntile, percent_rank,
    percentile, rank, row_number, shift, stddev, sum_, when,
)
from panewright.plans.frame import Frame
from panewright.plans.rewrite import Rewrites
from panewright.plans.window import WindowDef, asc, desc, window

__all__ = [
    "Frame", "Rewrites", "WindowDef", "agg", "asc", "avg", "coalesce", "col", "count", "count_distinct", "cume_dist", "dense_rank", "desc", "first",
    "lag", "last", "lead", "lit", "max_", "min_", "ntile", "percent_rank", "percentile", "rank", "row_number", "shift", "stddev", "sum_", "when", "window",
]
