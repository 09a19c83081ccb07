"""Markup queries equal their statement where a reference has no semicolon."""

from __future__ import annotations

import duckdb
import pytest

from attesta.plans import text_queries  # noqa: F401
from attesta.plans.registry import ORACLES, QUERIES

PAGES = ["a &amp<b>x</b> b", "and&amp; &ampc &copy 2 &copy; &am<i>p;</i>", "&amp;lt; &amp;amp", "it\\'s &#39;q&#39 &quot", "plain &", ""]


@pytest.mark.parametrize("name", ["strip_markup", "strip_markup_exact"])
def test_open_references_stay(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        stated = sorted(map(tuple, duck.sql(ORACLES[name]).df().itertuples(index=False)))
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == stated
