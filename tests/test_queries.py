"""Every query of the core beside its SQL, over the whole tables of the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from panewright.queries import data, windows
from tests.oracle import compare

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [*data.QUERIES, *windows.QUERIES])
def test_query_equals_sql(spark, name) -> None:  # noqa: ANN001
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, TABLES).columns
    else:
        assert compare(spark, TABLES, query, sql) == ""


def test_entry(spark) -> None:  # noqa: ANN001
    assert entry.entry(spark).count() > 0


def test_partition_filter_and_columns_reach_the_scan(spark) -> None:  # noqa: ANN001
    plan = windows.filter_part(spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_custkey,100)" in plan and "WindowGroupLimit" in plan
    assert "o_totalprice" not in plan
