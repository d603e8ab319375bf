"""The registered queries over the smallest tables, beside SQL where there is any."""

from __future__ import annotations

import pytest

from panewright.llm import queries as Q
from tests.oracle import compare

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, name) -> None:  # noqa: ANN001
    if name in Q.SQL:
        assert compare(spark, TABLES, Q.QUERIES[name], Q.SQL[name]) == ""
    else:
        Q.QUERIES[name](spark, TABLES).collect()


def test_ids_are_one_row_per_document(spark) -> None:  # noqa: ANN001
    rows = Q.p7_ids(spark, TABLES).collect()
    assert len(rows) == spark.read.parquet(f"{TABLES}/documents.parquet").count() and all(r["ids"] is not None for r in rows)


def test_layouts_are_kept_and_asked_again(spark, tmp_path) -> None:  # noqa: ANN001
    spark.conf.set(Q.LAYOUTS, str(tmp_path / "layouts"))
    try:
        runs = [sorted(map(tuple, Q.p4_found(spark, TABLES).collect())) for _ in range(2)]
        files = sorted(p.name for p in (tmp_path / "layouts").rglob("*.parquet"))
        Q.p4_skipped(spark, TABLES).collect()
        assert runs[0] == runs[1] and files == sorted(p.name for p in (tmp_path / "layouts").rglob("*.parquet"))
    finally:
        spark.conf.unset(Q.LAYOUTS)


def test_models_are_kept_and_read_again(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    spark.conf.set(Q.MODEL, str(tmp_path / "model"))
    try:
        one = sorted(r[0] for r in Q.p9_found(spark, "/root/testdata/sf0.01").collect())
        monkeypatch.setattr(Q.abuse, "train", None)
        assert sorted(r[0] for r in Q.p9_found(spark, "/root/testdata/sf0.01").collect()) == one
    finally:
        spark.conf.unset(Q.MODEL)
