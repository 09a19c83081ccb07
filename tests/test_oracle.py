"""Every registered query of the library against its DuckDB statement, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from attesta.plans import detail_queries, label_queries, linkage_queries, outgoing_queries, pass_queries, store_queries, text_queries  # noqa: F401
from attesta.plans.registry import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def plain(frame):
    def value(x):
        if x is None or x != x:
            return None
        if isinstance(x, float):
            return int(x) if math.isfinite(x) and x == int(x) else round(x, 6)
        return x.item() if hasattr(x, "item") else x

    columns = sorted(frame.columns)
    return columns, sorted((tuple(str(value(x)) for x in row) for row in frame[columns].astype(object).itertuples(index=False)))


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as connection:
        for t in TABLES:
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        yield connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_statement(spark, duck, name):
    assert plain(QUERIES[name](spark, str(DATA)).toPandas()) == plain(duck.sql(ORACLES[name]).df().replace({float("nan"): None}))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    frame = QUERIES[name](spark, str(DATA))
    assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)
